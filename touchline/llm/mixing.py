"""Mixing sources to target weights: Efraimidis-Spirakis sampling, with DataFrame functions only.

Each source gets a target in words. Complete epochs come first: a document is taken floor(target / source size) times. The rest of
the target is a weighted sample without replacement: each document has an exponential key -ln(u) / weight, keys are sorted
within the source, sizes are prefix-summed, and documents are taken up to the prefix that comes closest to the rest.

u is a hash of the id and the seed, so reruns agree. No source is sorted in one task: sizes are summed by (source, key
bucket), and only the rows of the one bucket in which the rest ends are sorted, so what comes out is one key for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
BUCKETS = 1024
#: Most sources whose facts are broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def size_in_words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text_col: str = "text", size: str = "size") -> Column:
    """1 for texts of six characters a word (white space included), less the further from it; 1 for texts without words."""
    ratio = F.char_length(text_col).cast("double") / F.nullif(F.col(size), F.lit(0)).cast("double")
    return F.coalesce(1.0 / (1.0 + F.abs(ratio - 6.0) / 6.0), F.lit(1.0))


def keyed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, prefix: str = "") -> DataFrame:
    """docs with size, key and bucket (names after ``prefix``). Null ids draw by their text."""
    p = prefix
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 13), 16, 10).cast("double")
    out = docs.withColumn(f"{p}size", size_in_words(text_col))
    out = out.withColumn(f"{p}key", -F.log((drawn + 0.5) / float(1 << 52)) / quality_weight(text_col, f"{p}size"))
    return out.withColumn(f"{p}bucket", F.least(F.lit(BUCKETS - 1), F.floor((1.0 - F.exp(-F.col(f"{p}key"))) * BUCKETS)).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """source, source_size and target: sources in code point order, null last, weigh ``weights``, repeating; they share ``share`` of all sizes;
    targets stop at ``cap`` times the source's size and the excess goes to the others by weight.

    In ascending order of cap / weight the capped sources come first, so one pass of running sums finds the level. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.lit(list(weights)).cast("array<bigint>"), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * cap)
    by = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - before) / rest)
    level = F.max(F.when(F.col("most") / F.col("w") > F.col("level"), F.col("level"))).over(everything)
    target = F.coalesce(F.least(F.col("most").cast("double"), level * F.col("w")), F.col("most").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def facts(light: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, epochs and last_key of each source, from rows of source, size, key and bucket."""
    goals = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0))
    goals = goals.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goals = materialize(goals, "targets")
    sums = light.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("size").over(upto))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ends = sums.join(goals, same(sums, goals)).filter("upto >= rest and rest > 0").groupBy(goals["source"]).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "rest"), "bucket").alias("e"))
    ends = ends.select("source", "e.*")
    last = light.join(ends, same(light, ends) & (light["bucket"] == ends["bucket"])).select(light["source"], "key", "size", F.col("rest") - F.col("before"), ends["bucket"].alias("bucket"))
    last = last.toDF("source", "key", "size", "need", "bucket")
    # Equal keys (repeated rows) are taken together: they are one row, summed partially, before any are put in order.
    last = last.groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("need").alias("need"), F.first("bucket").alias("bucket"))
    last = last.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("key")))
    taken = (F.col("upto") <= F.col("need")) | ((F.col("upto") - F.col("need")) < (F.col("need") - (F.col("upto") - F.col("size"))))
    # Where not even the first row is taken, all rows of the buckets before are.
    keys = last.groupBy("source").agg(F.max(F.when(taken, F.col("key"))).alias("last_key"), F.first("bucket").alias("end_bucket"))
    out = goals.join(keys, goals["source"].eqNullSafe(keys["source"]), "left")
    return out.select(goals["source"].alias("of"), "source_size", "target", "epochs", "last_key", F.coalesce("end_bucket", F.lit(-1)).alias("end_bucket"))


def copies(rows: DataFrame, known: DataFrame, source_col: str = "source", prefix: str = "") -> DataFrame:
    """rows with source_size, target and copies of their source's facts (names after ``prefix``)."""
    p = prefix
    known = known.toDF(*[f"__f_{c}" for c in known.columns])
    if known.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    out = rows.join(known, F.col(source_col).eqNullSafe(F.col("__f_of")))
    more = (F.col(f"{p}bucket") < F.col("__f_end_bucket")) | ((F.col(f"{p}bucket") == F.col("__f_end_bucket")) & F.coalesce(F.col(f"{p}key") <= F.col("__f_last_key"), F.lit(False)))
    out = out.withColumn(f"{p}copies", F.col("__f_epochs") + more.cast("int"))
    out = out.withColumn(f"{p}source_size", F.col("__f_source_size")).withColumn(f"{p}target", F.col("__f_target"))
    return out.drop(*[f"__f_{c}" for c in ("of", "source_size", "target", "epochs", "last_key", "end_bucket")])


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row.

    Null texts have size 0; a null source is a source of its own, last in order; sources without words have target 0; repeated rows share their
    draw; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    light = materialize(keyed(rows, seed=seed).select("doc_id", "source", "size", "key", "bucket"), "keys")
    known = materialize(facts(light, weights, cap), "facts")
    return copies(light, known).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def resample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42) -> DataFrame:
    """docs with each row as often as the mix takes it, in the same columns. Texts are not shuffled: only each source's last key reaches them.

    Documents without words go with their source's draw.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    light = materialize(keyed(rows, seed=seed).select("source", "size", "key", "bucket"), "keys")
    known = materialize(facts(light, weights, cap), "facts")
    wide = copies(keyed(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, prefix="__m_"), known, source_col, "__m_")
    wide = wide.filter("__m_copies > 0").withColumn("__m_i", F.explode(F.sequence(F.lit(1), F.col("__m_copies"))))
    return wide.select(*[F.col(c) for c in docs.columns])
