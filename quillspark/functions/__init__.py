"""Scalar building blocks: analysis, dates, numeric functions and geometry."""
