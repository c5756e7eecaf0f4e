"""Document fingerprints by winnowing, with DataFrame functions only.

A text is lower-cased and cut into tokens: runs between ASCII white space; letters of scripts without spaces stand alone. Runs of more than twelve
characters are cut behind every byte of their UTF-8 form, but for lead bytes, that leaves 1 when divided by four: so every script is cut, and text that is
shared anywhere in long runs is cut alike, at any offset. A gram's value is the polynomial rolling hash (Karp-Rabin) of ``2 ** gram_log`` consecutive token hashes, modulo a prime: that of
2n tokens follows from those of n, so values double instead of being carried along the array, as do the minima of each window of
``2 ** window_log`` grams. A window's minimum is kept with its position; of equal hashes the rightmost wins, as the packed
value holds the hash above the complement of the position.

Guarantee: a run of ``window + gram - 1`` tokens (11 by default) that two texts share has a common fingerprint hash. So have 11 shared
characters of a script without spaces, and any stretch with 12 cuts that two runs of more than twelve characters share (where bytes are spread evenly, one in four has a cut).
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import materialize

SPACES = r"\x20\x09-\x0D"
#: Scripts without spaces: Thai to Myanmar, Khmer, radicals to Hangul, compatibility and wide forms, the supplementary ideographs.
ALONE = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{D7FF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}"
#: A letter by itself, or a run.
RUN = rf"[{ALONE}]|[^{SPACES}{ALONE}]++"
#: Most characters of a run that is not cut.
WHOLE = 12
#: Bytes, as Latin-1 characters, behind which longer runs are cut; a piece is up to the next of them, or the rest.
CUT = "".join(f"\\x{b:02X}" for b in range(0xC0) if b % 4 == 1)
PIECE = rf"[^{CUT}]*+[{CUT}]|[^{CUT}]++"
#: Modulus and base of the rolling hash: products stay below 2 ** 62.
PRIME, BASE = (1 << 31) - 1, 1_000_003
#: Lower 32 bits of a packed value: the complement of the position. Above it: 31 bits of hash.
POSITION = (1 << 32) - 1
HASH = (1 << 31) - 1
LEAST_ID = -(1 << 63)
#: Most id ranges that documents are dealt into, and their size where that is enough; their first rows' keys, one each, are all that is broadcast.
MOST_RANGES, RANGE_BYTES = 65_536, 32 << 20


def _pairs(a: str, step: int, f) -> Column:
    """f of the elements i and i + step of array column a (empty if there are none)."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), f)


def _rolled(times: int):
    """The rolling hash of two neighbouring runs of tokens: times is the base to the power of the second's length."""
    return lambda a, b: (a * F.lit(times).cast("long") + b) % F.lit(PRIME).cast("long")


def _cut(runs: str) -> Column:
    """The tokens of an array column of runs: most texts have no long run, and keep the array as it is."""
    long = lambda t: F.char_length(t) > WHOLE
    pieces = lambda t: F.regexp_extract_all(F.decode(t.cast("binary"), "ISO-8859-1"), F.lit(PIECE), F.lit(0))
    cut = F.flatten(F.transform(runs, lambda t: F.when(long(t), pieces(t)).otherwise(F.array(t))))
    return F.when(F.exists(runs, long), cut).otherwise(F.col(runs))


def winnow(df: DataFrame, text: str, out: str, *, gram_log: int = 2, window_log: int = 3) -> DataFrame:
    """df with ``out``: packed hash and position of each selected gram of column ``text``, in order of position.

    Null and empty texts, and white space only: an empty array. Fewer tokens than a gram: one gram of all tokens; fewer grams than
    a window: one window of all grams. Texts of any length are whole. Temporary columns start with two underscores and ``out``.
    """
    # Each step is a column of its own, used more than once by the next, so that the optimizer doesn't repeat its work.
    runs, tok, at = f"__{out}_r", f"__{out}_t", f"__{out}_h"
    gram, window = 1 << gram_log, 1 << window_log
    df = df.withColumn(runs, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(RUN), F.lit(0)))
    df = df.withColumn(tok, _cut(runs))
    df = df.withColumn(at, F.transform(tok, lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME).cast("long"))))
    steps = [at]
    for i in range(gram_log):
        df = df.withColumn(f"{at}{i}", _pairs(steps[-1], 1 << i, _rolled(pow(BASE, 1 << i, PRIME))))
        steps.append(f"{at}{i}")
    few = F.when(F.size(at) == 0, F.col(at)).otherwise(F.array(F.aggregate(at, F.lit(0).cast("long"), _rolled(BASE))))
    packed = f"__{out}_p"
    df = df.withColumn(f"{packed}0", F.when(F.size(at) >= gram, F.col(steps[-1])).otherwise(few))
    pack = lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(HASH)), 32).bitwiseOR(F.lit(POSITION).cast("long") - i.cast("long"))
    df = df.withColumn(packed, F.transform(f"{packed}0", pack))
    mins = [packed]
    for i in range(window_log):
        df = df.withColumn(f"{packed}m{i}", _pairs(mins[-1], 1 << i, lambda a, b: F.least(a, b)))
        mins.append(f"{packed}m{i}")
    short = F.when(F.size(packed) == 0, F.col(packed)).otherwise(F.array(F.array_min(packed)))
    df = df.withColumn(out, F.array_distinct(F.when(F.size(packed) >= window, F.col(mins[-1])).otherwise(short)))
    return df.drop(runs, tok, *steps, f"{packed}0", *mins)


def hashes(fingerprint: Column | str) -> Column:
    """The hashes of a fingerprint, each once."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32)))


def positions(fingerprint: Column | str) -> Column:
    """Token positions (from 0) of a fingerprint's grams."""
    return F.transform(fingerprint, lambda x: F.lit(POSITION).cast("long") - x.bitwiseAND(F.lit(POSITION).cast("long")))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two columns of hashes; both empty: 1."""
    both, common = F.size(F.array_union(a, b)), F.size(F.array_intersect(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(common / F.greatest(both, F.lit(1)))


def as_text(fingerprint: Column | str) -> Column:
    """16 hexadecimal digits a gram: 8 of the hash, 8 of ffffffff minus the position."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ",")


def _ranged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key (the id; null as the smallest), sub (orders rows of one id) and range: neighbours in order of key and sub meet in one task.

    Ranges hold about RANGE_BYTES. Rows of an id that fills several ranges are dealt among them by sub: digest of the text above a draw, as equal rows may hold any order.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(LEAST_ID)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES)))
    cuts = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).first()["c"] or [0]
    many = {k: n for k, n in Counter(cuts).items() if n > 1}
    cuts = sorted(set(cuts))
    width = math.isqrt(len(cuts)) + 1
    listed = lambda a: F.split(F.lit(",".join(map(str, a))), ",").cast("array<bigint>")
    # The number of cuts up to the key, in two steps: which stretch of cuts, then within it.
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col("key")))
    heads = cuts[width - 1 :: width]
    rows = rows.withColumn("stretch", below(listed(heads)) if heads else F.lit(0))
    inner = F.slice(listed(cuts), F.col("stretch") * width + 1, F.lit(width))
    rows = rows.withColumn("range", ((F.col("stretch") * width + below(inner)) * MOST_RANGES).cast("long")).drop("stretch")
    if not many:
        return rows.withColumn("sub", F.xxhash64("text"))
    # Hot ids, fewer than ranges: their rows' subs are drawn once and written, so that retried tasks deal them alike.
    times = spark.createDataFrame(list(many.items()), "key long, times int")
    hot = rows.join(F.broadcast(times), "key")
    low = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))
    hot = materialize(hot.withColumn("sub", F.shiftleft(F.shiftright(F.xxhash64("text"), 20), 20) + low), "hot")
    share = F.transform(F.sequence(F.lit(1), F.col("times")), lambda i: i / (F.col("times") + 1))
    parts = hot.groupBy("key", "times").agg(F.percentile_approx("sub", [i / 64 for i in range(1, 64)], 10_000).alias("p"))
    parts = parts.select("key", F.array_distinct(F.transform(share, lambda x: F.element_at("p", F.least(F.lit(63), F.greatest(F.lit(1), F.round(x * 64).cast("int")))))).alias("p"))
    hot = hot.drop("times").join(F.broadcast(parts), "key").withColumn("range", F.col("range") + F.size(F.filter("p", lambda c: c <= F.col("sub")))).drop("p")
    # The other ids from a hot one up to the next cut come after all of its parts.
    cold = rows.join(F.broadcast(times), "key", "left_anti").withColumn("sub", F.xxhash64("text")).withColumn("range", F.col("range") + MOST_RANGES - 1)
    return cold.unionByName(hot)


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram_log: int = 2, window_log: int = 3) -> DataFrame:
    """For every document: its fingerprint, that of its edited text, and how alike they and the next document's are.

    The next document is that of the next smaller id (after the smallest: the largest); ids that repeat follow each other in descending order of their texts'
    digest, null ids come last. The edited text ends in as many of the next document's first code points as the last third had.
    Null texts count as empty; a single document is its own next; an empty table gives no rows.

    Texts are shuffled once, by id range. Each range also gets a copy of the first document of the range after it.
    """
    rows = _ranged(docs, id_col, text_col)
    # The first document of each range in order: of the largest key, then sub, then text.
    first = F.struct("key", "sub", "text")
    heads = rows.groupBy("range").agg(F.max(F.struct("key", "sub")).alias("h")).select("range", "h.key", "h.sub")
    # As many rows as ranges. The range before a head's own is the next larger range that has rows; the largest head follows the smallest.
    order = Window.orderBy(F.desc("range"))
    ahead = heads.withColumn("before", F.lag("range").over(order)).withColumn("last", F.min("range").over(Window.partitionBy()))
    ahead = F.broadcast(ahead.select("range", "key", "sub", F.coalesce("before", "last").alias("before")))
    ends = rows.join(ahead, ["range", "key", "sub"]).groupBy("before").agg(F.max(first).alias("f"))
    ends = ends.select(F.lit(None).cast("long").alias("doc_id"), "f.text", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("sub"), F.col("before").alias("range"))
    all_rows = rows.withColumn("end", F.lit(0)).unionByName(ends.withColumn("end", F.lit(1)))
    dealt = all_rows.repartition(F.col("range"))
    dealt = winnow(dealt, "text", "fp", gram_log=gram_log, window_log=window_log)
    w = Window.partitionBy("range").orderBy("end", F.desc("key"), F.desc("sub"), F.desc("text"))
    dealt = dealt.withColumn("next", F.lead(F.struct("text", "fp")).over(w)).filter("end = 0")
    n, third = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    dealt = dealt.withColumn("n_chars", n.cast("long")).withColumn("next_fp", F.col("next.fp"))
    dealt = dealt.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third)))
    dealt = dealt.select("doc_id", "n_chars", "edited", "fp", "next_fp")
    dealt = winnow(dealt, "edited", "edited_fp", gram_log=gram_log, window_log=window_log)
    return dealt.withColumns({"own": hashes("fp"), "other": hashes("edited_fp"), "next": hashes("next_fp")}).select(
        "doc_id", "n_chars", "edited", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )
