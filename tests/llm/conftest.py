import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use within.
CLASHING = ["id", "t", "fp", "word", "key", "size", "row", "spans", "score", "u", "v", "end", "range", "next", "bucket", "value", "n", "copies", "target", "owner"]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(["alpha", "Beta", "gamma,", "delta.", "épsilon", "zeta", "Ωmega", "x1", "theta\n", "iota"]) + r.choice(["", "s", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids."""
    r = random.Random(7)
    rows = [(i, prose(r, r.randint(1, 200)), r.choice(["en", "de"]), f"src{i % 4}", 0) for i in range(40)]
    base = prose(r, 300)
    rows += [
        (40, None, "en", "src0", None), (41, "", "en", "src1", 0), (42, " \t\n ", None, "src1", 4), (None, "no id here", "en", "src2", 10), (None, "no id here", "en", "src2", 10),
        (43, "no source", "en", None, 9), (44, prose(r, 20_000), "en", "src3", 0), (45, base, "en", "src0", 0), (46, base, "en", "src0", 0), (46, base, "en", "src0", 0),
        (47, base + " more", "en", "src1", 0), (47, "another text of the same id", "en", "src1", 0), (48, "😀" * 50 + "\x00 日本語", "ja", "src2", 0), (49, "x" * 5000, "en", "src2", 0),
        (-3, "negative id", "en", "src2", 0), (None, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def texts(odd_rows):
    return {r[0]: r[1] or "" for r in odd_rows if r[0] is not None}
