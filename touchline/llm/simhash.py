"""Near duplicates by SimHash: pivot distance tables discard pairs, survivors are verified, links become components.

A pivot distance table holds a fingerprint's Hamming distances to many reference fingerprints. By the triangle inequality two
fingerprints within ``bits`` differ by at most ``bits`` in every coordinate, so a larger coordinate difference discards a pair.

Which pairs meet: the 64 bits fall into ``bits + 2`` blocks; within ``bits`` bits at least two blocks agree, so each distinct fingerprint has
a key for each choice of two blocks. The first pivots' distances deal a key's fingerprints into cells: one goes to its own cell and, near the
upper edge of a coordinate, to the next one, so that fingerprints that differ by at most ``bits`` in these coordinates meet.
A cell's pairs are compared by the other pivots first; what the tables can't discard is verified by the exact distance.
A cell with more than MOST_CELL fingerprints is dealt again, by six of eight blocks of the bits that its key leaves open: so no group is
larger than MOST_CELL or 2 ** (open bits / 4), whatever the number of documents, and copies count once.
A group gives at most one edge per member (to a member of its local component), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import join_hot, materialize, slices, text_bytes, words

AGREE = 2
SEED = 42
#: Pivots whose distances make cells, and a cell's width in each.
CELL_PIVOTS, CELL_WIDTH = 2, 8
#: Most fingerprints of a cell that are compared without dealing them again.
MOST_CELL = 4096
#: From so many edges on, hubs are split off the joins.
MANY_EDGES = 1_000_000
#: Reference fingerprints, the same in every run.
PIVOTS = np.random.default_rng(64).integers(0, 2**64, size=16, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a text's word shingles: lower-cased A-Z, words between ASCII white space, repeats included.

    bytes.lower and bytes.split do exactly that and leave other bytes alone. Fewer words than a shingle: the whole sequence; none: 0.
    """
    ones, n, held = np.zeros(64, dtype=np.int64), 0, []
    for part in words(text):
        own = held + part
        count = max(0, len(own) - shingle + 1)
        hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*[own[i:] for i in range(shingle)], strict=False)), repeat(SEED))
        for at in range(0, count, 65536):
            h = np.fromiter(hashes, dtype="<u8", count=min(65536, count - at))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n, held = n + count, own[len(own) - shingle + 1 :] if len(own) >= shingle else own
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a signed long) and node (the text's digest) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for part in slices(b.column(1)) for t in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64()), b.column(2)], names=["id", "fp", "node"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"), digest(text_col).alias("node"))
    return rows.mapInArrow(run, "id long, fp long, node long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each reference."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)


def survivors(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether the pivot tables leave each pair (rows of two tables): no coordinate differs by more than ``bits``."""
    near = np.ones(len(a), dtype=bool)
    for p in range(a.shape[1] - 1, -1, -1):  # the first pivots made the cells, so they tell least
        near[near] = np.abs(a[near, p] - b[near, p]) <= bits
    return near


def verify(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether fingerprints of each pair differ in at most ``bits`` bits."""
    return np.bitwise_count(a ^ b) <= bits


def bucket_links(fps: np.ndarray, bits: int, rows: int = 512) -> list[tuple[int, int]]:
    """Edges that join the local components of one group: (smaller, larger) fingerprints, at most one for each member.

    Each edge joins two linked components, so the edges of all groups together have the components of all the links.
    Rows are sorted by the last pivot's distance and meet only within a band of ``bits``, in blocks.
    """
    fps = np.unique(fps)
    table = pivot_table(fps)
    order = np.argsort(table[:, -1], kind="stable")
    fps, table = fps[order], table[order]
    last = table[:, -1]
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, len(fps), rows):
        own = slice(at, min(at + rows, len(fps)))
        end = int(np.searchsorted(last, last[own.stop - 1] + bits, side="right"))
        for start in range(at, end, 4096):
            stop = min(start + 4096, end)
            near = np.arange(at, own.stop)[:, None] < np.arange(start, stop)[None, :]
            for p in range(table.shape[1] - 1, -1, -1):  # the largest coordinate difference, one coordinate at a time
                near &= np.abs(table[own, p][:, None] - table[start:stop, p][None, :]) <= bits
                if not near.any():
                    break
            i, j = np.nonzero(near)
            i, j = i + at, j + start
            ok = verify(fps[i], fps[j], bits)
            for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
    return [(int(fps[find(i)]), int(fps[i])) for i in range(len(fps)) if find(i) != i]


def _masks(blocks: int, agree: int, within: int = (1 << 64) - 1) -> list[int]:
    """For each choice of ``agree`` of ``blocks`` equal parts of the bits of ``within``: their mask."""
    at = [i for i in range(64) if within >> i & 1]
    cuts = [round(i * len(at) / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in at[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(distinct: DataFrame, bits: int) -> DataFrame:
    """fp, n (which blocks), k (their bits) and cell of each fingerprint: a row for each key and cell that it goes to."""
    fp = F.col("fp")
    homes = []
    for p in range(CELL_PIVOTS):
        d = F.bit_count(fp.bitwiseXOR(F.lit(_signed(int(PIVOTS[p]))).cast("long")))
        own, ahead = F.floor(d / CELL_WIDTH).cast("int"), F.floor((d + bits) / CELL_WIDTH).cast("int")
        homes.append(F.array_distinct(F.array(own, ahead)))
    cells = reduce(lambda cells, home: F.flatten(F.transform(cells, lambda a: F.transform(home, lambda b: a * 64 + b))), homes)
    keys = [F.struct(F.lit(n).cast("byte").alias("n"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k")) for n, m in enumerate(_masks(bits + AGREE, AGREE))]
    # By an expression of its own and a number of our own: else the exchange goes, or adaptive execution coalesces what becomes some ten times as much.
    even = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp", F.lit(1)))
    return even.select("fp", F.explode(cells).alias("cell"), F.array(*keys).alias("keys")).select("fp", "cell", F.explode("keys").alias("key")).select("fp", "cell", "key.n", "key.k")


def _finer(full: DataFrame, bits: int) -> DataFrame:
    """Groups of the fingerprints of full cells: by six of ``bits + 6`` blocks of the bits that the cell's key leaves open."""
    out = None
    for n, mask in enumerate(_masks(bits + AGREE, AGREE)):
        rest = ((1 << 64) - 1) ^ mask
        keys = [F.struct(F.lit(m).cast("int").alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x)).cast("long")).alias("rest")) for m, x in enumerate(_masks(bits + 6, 6, rest))]
        own = full.filter(F.col("n") == n).select("n", "k", "cell", "fp", F.explode(F.array(*keys)).alias("part"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("n", "k", "cell", "part").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (a, b) between different fingerprints of ``distinct`` (column fp, each once) whose components are those of all links within ``bits``."""
    dealt, cell = _dealt(distinct, bits), ["n", "k", "cell"]
    sizes = dealt.groupBy(*cell).agg(F.count("*").alias("c"))
    full = materialize(sizes.filter(F.col("c") > MOST_CELL).select(*cell), "full")
    if full.isEmpty():
        groups = dealt.groupBy(*cell).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    else:
        groups = dealt.join(full, cell, "left_anti").groupBy(*cell).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
        groups = groups.unionByName(_finer(dealt.join(full, cell, "left_semi"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            length = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[: int(length.sum()) + int(lists.offsets[0].as_py())]
            at = lists.offsets.to_numpy()[:-1]
            two = at[length == 2]  # most groups: all of a batch at once
            x, y = flat[two], flat[two + 1]
            near = survivors(pivot_table(x), pivot_table(y), bits)
            x, y = x[near], y[near]
            ok = verify(x, y, bits)
            pairs = [(x[ok], y[ok])]
            for i in np.flatnonzero(length > 2).tolist():
                if got := bucket_links(flat[at[i] : at[i] + length[i]], bits):
                    pairs.append(tuple(np.array(c, dtype=np.uint64) for c in zip(*got, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64), pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for each node of the edges (a, b): alternating large-star and small-star rounds.

    Each round is a written table; stops when a round changes no edge. Neighbours are never collected: minima are joined back.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(now)
    while seen[0]:
        # A hub with many neighbours has one row in ``least``: beyond what Spark broadcasts by itself, hubs are split off.
        joined = (lambda rows, known: join_hot(rows, known, "u")) if seen[0] > MANY_EDGES else (lambda rows, known: rows.join(known, "u"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = joined(both, least)
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(large.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "edges")
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def digest(text_col: str = "text") -> Column:
    """64 bits of a text's bytes; null counts as empty."""
    return F.xxhash64(text_bytes(text_col))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """id, node (the text's digest), fp, root (the same for all rows of a group) and component_id of every row."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), bits))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(whole, "root").select("fp", "root", "component_id")
    return join_hot(fps, named, "fp").select("id", "node", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row.

    component_id is the smallest doc_id that links within ``bits`` reach, the document's own included. Null and empty texts, or white space only, have
    fingerprint zero and link like any other; a null id keeps its row and counts in no minimum; repeated rows stay; an empty
    table gives no rows.
    """
    out = near_groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, bits=bits)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of ``groups`` (id, node, root): that of the smallest id, null last, then of the smallest digest.

    An id repeated in several groups stays in each of them that it is first in; a group of null ids keeps one. Rows equal in id and text are of one
    group: of them the least by all columns stays, by their texts where columns have no order (maps).
    """
    keys = ["__keep_node", "__keep_null", "__keep_id"]
    named = lambda node, key: [node.alias(keys[0]), key.isNull().alias(keys[1]), F.coalesce(key, F.lit(0).cast("long")).alias(keys[2])]
    order = F.struct(F.col("id").isNull().alias("null"), "id", "node")
    first = groups.groupBy("root").agg(F.min(order).alias("f")).select(*named(F.col("f.node"), F.col("f.id"))).distinct()
    # Of rows equal in id and text only one is moved by each task, and the join needs no other shuffle of texts.
    ordered = lambda c: F.col(c).cast("string") if "map<" in docs.schema[c].dataType.simpleString() else F.col(c)
    others = [ordered(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in (id_col, text_col)]
    least = F.min_by(F.struct(*docs.columns), F.struct(F.col(text_col).isNotNull().alias("text"), *others))
    whole = docs.groupBy(*named(digest(text_col), F.col(id_col).cast("long"))).agg(least.alias("__row"))
    return whole.join(first, keys, "left_semi").select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """docs with one row of each group of near_duplicates, in the same columns: see keep_first."""
    return keep_first(docs, near_groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, bits=bits), id_col, text_col)
