"""Isotonic regression by pooling adjacent violators, as a merge of blocks.

Rows of equal x are summed first. Blocks of sorted ranges are pooled in tasks, and pooled blocks of neighbouring ranges again, until few are left: pooling what
was pooled gives what pooling all rows at once does. What remains is the fit, a short list of steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

BLOCK = "lo double, hi double, w double, wy double"
#: Blocks that are pooled in one place; with more, a further round of tasks pools them first.
FEW = 100_000


def pooled(blocks: Iterator[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """(lo, hi, weight, weighted sum), in order of lo, so that means rise: a block that is not above the one before joins it."""
    out: list[tuple[float, float, float, float]] = []
    for lo, hi, w, wy in blocks:
        while out and out[-1][3] * w >= wy * out[-1][2]:
            a, _, v, vy = out.pop()
            lo, w, wy = a, v + w, vy + wy
        out.append((lo, hi, w, wy))
    return out


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = pooled(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (zip(*got, strict=True) if got else [[]] * 4)], names=["lo", "hi", "w", "wy"])


@dataclass
class Isotonic:
    """A rising function: ys at xs, straight between them, level beyond."""

    xs: list[float]
    ys: list[float]

    def __call__(self, x: Column | str) -> Column:
        """The function of a column; null and NaN stay null. Without points: null."""
        return F.get(corrected([self], [F.col(x) if isinstance(x, str) else x]), F.lit(0))


def corrected(functions: list[Isotonic], columns: list[Column]) -> Column:
    """array<double> of each function of its column, as in Isotonic, all in one pass: a task has one Python worker, however many functions there are."""
    points = [(f.xs, f.ys) for f in functions]

    @arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(points))
            out = np.full(v.shape, np.nan)
            for i, (xs, ys) in enumerate(points):
                if xs:
                    out[:, i] = np.interp(v[:, i], xs, ys)
            flat, ends = out.ravel(), np.arange(0, out.size + 1, len(points), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float64(), mask=np.isnan(v).ravel() | np.isnan(flat)))

    return run(F.array(*[c.cast("double") for c in columns]))


def fit(rows: DataFrame, x: Column, y: Column, few: int = FEW) -> Isotonic:
    """The rising function nearest to y (least squares) over rows with both known."""
    each = rows.select(F.nanvl(x.cast("double"), F.lit(None)).alias("lo"), y.cast("double").alias("y")).filter("lo is not null and y is not null")
    blocks = each.groupBy("lo").agg(F.count("*").cast("double").alias("w"), F.sum("y").alias("wy")).select("lo", F.col("lo").alias("hi"), "w", "wy")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held: list[DataFrame] = []
    try:
        while True:
            blocks = blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(_pool, BLOCK).persist()
            held.append(blocks)
            if parts == 1 or blocks.count() <= few:
                break
            parts = max(1, parts // 8)
        got = pooled(sorted(tuple(r) for r in blocks.collect()))
    finally:
        for own in held:
            own.unpersist()
    xs, ys = [], []
    for lo, hi, w, wy in got:
        for v in dict.fromkeys((lo, hi)):
            xs.append(v)
            ys.append(wy / w)
    return Isotonic(xs, ys)
