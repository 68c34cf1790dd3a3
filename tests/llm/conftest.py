import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages, repeats, nulls, empties, repeated rows and a long text."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(5, 160)) for _ in range(40)]
    passage = prose(rng, 70)
    texts = list(base)
    texts += [base[3], base[3], base[7]]
    for k in (5, 9, 11):
        words = base[k].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    texts += ["a" * 400, "ab" * 300, "é" * 150 + " naïve " + "é" * 150, passage + "\n" + passage, "", None, " \n\t ", "12 34", "x"]
    texts.append(prose(rng, 9000) + " " + passage)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0], rows[1]]
    return rows


def frame(spark, rows, extra: bool = True):
    """Rows (doc_id, text) as documents; extra columns clash with names that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for name in ("place", "bucket", "hash", "kind", "id", "row", "a", "b", "length", "rank", "_n"):
            df = df.withColumn(name, F.lit("x"))
    return df
