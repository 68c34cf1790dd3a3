"""Operators over any DataFrame: facets, statistics, grouping, order, retrieval components."""
