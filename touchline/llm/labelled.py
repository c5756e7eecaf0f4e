"""Bounded labelled samples for fitting: texts and labels of at most so many documents, whatever the size of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import fold, text_bytes

FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str = "doc_id"):
    return fold(F.col(id_col), FOLDS) == HELD_OUT


def picked(docs: DataFrame, labels: DataFrame, label: str, *, rows: int, share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """t, y (text and label) of at most ``rows`` labelled documents outside the held-out fold, the first in order of a hash of the id.

    share: the part with label 1, where there are enough (None: as they come). Null labels and ids don't count; of different labels for an id the
    largest does. Texts are whole, of any length.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.filter(fold(F.col("id"), FOLDS) != HELD_OUT).groupBy("id").agg(F.max("y").alias("y"))
    order = (F.xxhash64("id"), F.col("id"))
    if share is not None:
        ones = int(rows * share)
        chosen = known.filter("y = 0").orderBy(*order).limit(rows - ones).unionByName(known.filter("y = 1").orderBy(*order).limit(ones))
    else:
        chosen = known.orderBy(*order).limit(rows)
    # The chosen ids are at most ``rows``, so they are broadcast and the texts stay where they are.
    own = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t")).join(F.broadcast(chosen), "id")
    return own.orderBy(*order, "t").limit(rows).select("t", "y")


def sample(docs: DataFrame, labels: DataFrame, label: str, **how) -> list[tuple[bytes, int]]:
    """The rows that ``picked`` gives. The driver holds their whole texts, so ``rows`` is what bounds its memory."""
    got = picked(docs, labels, label, **how).toArrow()
    return without_copies(list(zip(got.column("t").to_pylist(), got.column("y").to_pylist(), strict=True)))


def without_copies(rows: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """rows without repeated texts of one label."""
    return list(dict.fromkeys(rows))
