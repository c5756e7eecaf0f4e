"""Links between documents whose sets of five-word shingles are alike, for SimHash near-dedup beyond a few bits.

1. Each distinct text is a node. Candidates meet by keys. Texts of up to SHORT shingles: their rarest shingles, so many that two sets of
   the wanted likeness always share one (prefix filter). Longer ones: bands of ROWS of the set's MinHash values; all BANDS differ for a pair of
   likeness 0.8 in 5 of 100 million. Texts between SHORT and SHORT / similarity have both, as either can be their partner's.
2. Nodes of one key need no comparison where links join them already. While there are many other pairs, all members of a key meet
   two of them: that whose keys have most nodes, as the text that others were made from has, and others, which differ by turn and key; then every pair of a key that is still apart meets, in blocks within tasks. So no pair that shares a key is left out.
3. Sketches (the least shingle hash in each of 256 slots) discard pairs five deviations below; the survivors' sets are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import join_hot, materialize, slices, text_bytes
from touchline.llm.simhash import components, digest, fingerprint, keep_first, links

SHINGLE = 5
SLOTS = 256
BANDS, ROWS = 32, 4
#: Sets of at most so many shingles meet by their rarest shingles.
SHORT = 50
#: Sketches discard pairs so many deviations of the estimate below the wanted likeness.
DEVIATIONS = 5
#: All pairs of a key that are apart meet once there are at most so many for each member of a key, or after so many rounds.
PAIRS, ROUNDS = 8, 2
#: They meet within tasks, so many members of a key with as many others; what is compared there is short for up to LISTED shingles: two bytes of each.
BLOCK, LISTED = 256, 1024
#: Of longer sets, the least hash in each of so many slots. How far below the wanted likeness collisions of two bytes can bring a pair.
FINE_SLOTS, COLLISIONS = 1024, 0.03
CACHE = 200_000
MIX = np.random.default_rng(5).integers(0, 2**63, size=4096, dtype=np.uint64) | np.uint64(1)
#: Multipliers and summands of the MinHash functions.
TIMES, PLUS = np.random.default_rng(7).integers(0, 2**64, size=(2, BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    """word -> its hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, hashes: _Hashes) -> np.ndarray:
    """Hashes of the distinct five-word shingles, in order; of fewer words, of all of them; of none, empty."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - SHINGLE + 1)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        s += h[k : k + n] * MIX[k]
    return np.unique(_stir(s))


def sketch(s: np.ndarray) -> bytes:
    """A byte a slot, 0: empty."""
    slot, first = np.unique(s >> np.uint64(56), return_index=True)  # the slot is the highest byte, so a slot's least hash is its first
    out = np.zeros(SLOTS, dtype=np.uint8)
    out[slot.astype(np.int64)] = 1 + (s[first] % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def fine(s: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Two bytes of each shingle of sets of up to LISTED / similarity; of sets of more than LISTED, of the least in each slot (0: empty). So any two sets of the wanted likeness have one form in common."""
    none = np.zeros(0, dtype=np.uint16)
    long = none
    if len(s) > LISTED:
        slot, first = np.unique(s >> np.uint64(54), return_index=True)
        long = np.zeros(FINE_SLOTS, dtype=np.uint16)
        long[slot.astype(np.int64)] = 1 + (s[first] % np.uint64(65535)).astype(np.uint16)
    return np.unique((s & np.uint64(0xFFFF)).astype(np.uint16)) if len(s) * similarity <= LISTED else none, long


def likely(n: np.ndarray, short: list[np.ndarray], long: list[np.ndarray], left: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that may have the wanted likeness, of the first ``left`` members with the others (all of them: left = len(n), i < j)."""
    whole = left == len(n)
    a, b = np.arange(left), np.arange(len(n)) if whole else np.arange(left, len(n))
    small = np.array([len(x) > 0 for x in short])
    close = np.minimum(n[a][:, None], n[b][None, :]) >= np.maximum(n[a][:, None], n[b][None, :]) * similarity - 1e-9
    if whole:
        close &= a[:, None] < b[None, :]
    ok = np.zeros(close.shape, dtype=bool)
    length = np.array([len(x) for x in short])
    if small[a].any() and small[b].any():
        value, at = np.unique(np.concatenate(short), return_inverse=True)
        owner = np.repeat(np.arange(len(n)), length)
        more = np.bincount(at, minlength=len(value)) > 1
        column = np.cumsum(more) - 1
        keep = more[at]
        at, owner = column[at[keep]], owner[keep]
        both = np.zeros(close.shape, dtype=np.float32)
        for start in range(0, int(more.sum()), 8192):  # some values at a time
            own = (at >= start) & (at < start + 8192)
            table = np.zeros((len(n), 8192), dtype=np.float32)
            table[owner[own], at[own] - start] = 1
            both += table[a] @ table[b].T
        share = both / np.maximum(length[a][:, None] + length[b][None, :] - both, 1)
        ok |= small[a][:, None] & small[b][None, :] & (share >= similarity - COLLISIONS)
    large = np.array([len(x) > 0 for x in long])
    if large[a].any() and large[b].any():
        x, y = (np.stack([long[i] for i in side if large[i]]) for side in (a, b))
        for i, row in zip(np.flatnonzero(large[a]).tolist(), x, strict=True):
            used = np.maximum(((row > 0) | (y > 0)).sum(1), 1)
            share = ((row == y) & (row > 0)).sum(1) / used
            ok[i, np.flatnonzero(large[b])] |= share >= similarity - DEVIATIONS * np.sqrt(similarity * (1 - similarity) / used)
    i, j = np.nonzero(ok & close)
    return a[i], b[j]


def bands(s: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of its MinHash values."""
    if not len(s):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(s), 512):
        least = np.minimum(least, (s[None, at : at + 512] * TIMES + PLUS).min(axis=1))
    keys = (_stir(least).reshape(BANDS, ROWS) * MIX[:ROWS]).sum(axis=1, dtype=np.uint64) + MIX[ROWS : ROWS + BANDS]
    return _stir(keys).view(np.int64)


def profile(text: bytes, hashes: _Hashes) -> tuple[np.ndarray, bytes]:
    """Shingle hashes and sketch."""
    s = shingles(text, hashes)
    return s, sketch(s)


def alike(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Estimated likeness of pairs of sketches: equal slots among those that either has."""
    return _estimate(a, b)[0]


def _estimate(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and how many slots they rest on."""
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, SLOTS) for s in (a, b))
    used = np.maximum(((x > 0) | (y > 0)).sum(1), 1)
    return ((x == y) & (x > 0)).sum(1) / used, used


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float = 0.8) -> DataFrame:
    """id, fp (the SimHash of ``shingle`` words), node (the text's digest), n (distinct five-word shingles), bands and short (the shingles of short texts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                own = batch.slice(at, 1024)
                fps, n, long, short = [], [], [], []
                for part in slices(own.column(1)):
                    for t in part:
                        fps.append(fingerprint(t, shingle))
                        s = shingles(t, hashes)
                        n.append(len(s))
                        long.append(bands(s) if len(s) > SHORT else none)
                        short.append(s.view(np.int64) if len(s) * similarity <= SHORT else none)
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (long, short)]
                columns = [own.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64()), own.column(2), pa.array(n, pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "node", "n", "bands", "short"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"), digest(text_col).alias("node"))
    return rows.mapInArrow(run, "id long, fp long, node long, n long, bands array<long>, short array<long>")


def rarest(nodes: DataFrame, similarity: float) -> DataFrame:
    """node, fp, n, k: the rarest shingles of short texts, as many as leave less than the share ``similarity`` of the set."""
    rows = nodes.select("node", "fp", "n", F.explode("short").alias("s"))
    common = rows.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = rows.join(common, "s", "left").select("node", "fp", "n", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s").alias("r"))
    own = ranked.groupBy("node", "fp", "n").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # of one text, at most SHORT / similarity
    many = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    return own.select("node", "fp", "n", F.explode(F.slice("rs", F.lit(1), many)).alias("r")).filter("r.df > 1").select("node", "fp", "n", F.xxhash64(F.lit("short"), "r.s").alias("k"))


def shared_keys(nodes: DataFrame, similarity: float = 0.8) -> DataFrame:
    """node, fp, n, k, w: keys that more than one node has; w: how many nodes the node's keys have, which is most for the middle of a group."""
    keys = nodes.select("node", "fp", "n", F.explode("bands").alias("k")).unionByName(rarest(nodes, similarity))
    shared = keys.join(keys.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1"), "k")
    return shared.join(shared.groupBy("node").agg(F.sum("c").alias("w")), "node").select("node", "fp", "n", "k", "w")


def shingle_sets(docs: DataFrame, nodes: DataFrame, text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """node, sketch, short, long (both forms of fine()) and shingles of the texts of ``nodes`` (column node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                own = batch.slice(at, len(texts))
                at += len(texts)
                got = [profile(t, hashes) for t in texts]
                forms = [fine(g[0], similarity) for g in got]
                columns = [own.column(0), pa.array([g[1] for g in got], pa.binary()), *[pa.array([x[i].tobytes() for x in forms], pa.binary()) for i in (0, 1)], pa.array([g[0].view(np.int64) for g in got], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "sketch", "short", "long", "shingles"])

    rows = docs.select(digest(text_col).alias("node"), text_bytes(text_col).alias("t")).join(nodes, "node", "left_semi")
    return rows.dropDuplicates(["node"]).mapInArrow(run, "node long, sketch binary, short binary, long binary, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = 0.8, sketches: bool = True) -> DataFrame:
    """Those pairs (a, b, and what else they have) whose sets have a likeness of ``similarity`` or more: by sketches first, then exactly."""
    side = lambda x, c: sets.select(F.col("node").alias(x), F.col(c).alias(f"{c}_{x}"))
    columns = ["a", "b", "fa", "fb"]
    near = pairs
    if sketches:
        near = pairs.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b").select(*columns, "sketch_a", "sketch_b").mapInArrow(_maybe(similarity), "a long, b long, fa long, fb long")
    # Natively: Arrow batches of pairs of sets would take much of a worker's memory.
    whole = near.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
    whole = whole.withColumn("both", F.size(F.array_intersect("shingles_a", "shingles_b")))
    return whole.filter(F.col("both") >= (F.size("shingles_a") + F.size("shingles_b") - F.col("both")) * similarity - 1e-9).select(*columns)


def _maybe(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                own = batch.slice(at, 4096)
                got, used = _estimate(own.column(4).to_pylist(), own.column(5).to_pylist())
                ok = got >= similarity - DEVIATIONS * np.sqrt(similarity * (1 - similarity) / used)
                yield pa.RecordBatch.from_arrays([own.column(i) for i in range(4)], names=["a", "b", "fa", "fb"]).filter(pa.array(ok))

    return run


def all_pairs(own: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b, fa, fb: pairs of nodes with a key in common and different roots that may have the wanted likeness.

    A key's members are dealt to blocks, and each two blocks meet in a row of their own, where all pairs are compared; only what may be alike is emitted.
    """
    sized = own.join(own.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "k").withColumn("i", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    met = sized.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("k", F.least("i", "x").alias("p"), F.greatest("i", "x").alias("q"), "i", "node", "n", "r")
    met = met.join(sets.select("node", "short", "long"), "node")
    groups = met.groupBy("k", "p", "q").agg(F.collect_list(F.struct("i", "node", "n", "r", "short", "long")).alias("m")).filter(F.size("m") > 1).select("p", "q", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                p, q, m = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2).slice(row, 1).flatten()
                order = np.argsort(m.field("i").to_numpy(zero_copy_only=False), kind="stable")
                m = m.take(pa.array(order))
                i, node, n, r = (m.field(c).to_numpy(zero_copy_only=False) for c in ("i", "node", "n", "r"))
                left = len(i) if p == q else int((i == p).sum())
                if not left or (p != q and left == len(i)) or len(np.unique(r)) < 2:
                    continue
                forms = [[np.frombuffer(x, dtype=np.uint16) for x in m.field(c).to_pylist()] for c in ("short", "long")]
                a, b = likely(n, *forms, left, similarity)
                apart = r[a] != r[b]
                a, b = a[apart], b[apart]
                a, b = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[a], node[b], r[a], r[b])], names=["a", "b", "fa", "fb"])

    return groups.mapInArrow(run, "a long, b long, fa long, fb long").distinct()


def similar_links(keys: DataFrame, sets: DataFrame, edges: DataFrame, similarity: float = 0.8) -> DataFrame:
    """node (a fingerprint), root: components of ``edges`` (a, b: fingerprints) and of all pairs of ``keys`` (written) with a likeness of ``similarity``.

    Links that a turn finds join whole components, so only their roots are joined anew.
    """
    roots = materialize(components(edges.select("a", "b")), "roots")
    for turn in range(ROUNDS + 1):
        rooted = keys.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("k", "node", "fp", "n", "w", F.coalesce("root", "fp").alias("r"))
        rooted = materialize(rooted, "rooted")
        sizes = rooted.groupBy("k", "r").agg(F.count("*").alias("m")).groupBy("k").agg(F.sum("m").cast("double").alias("m"), F.sum(F.col("m").cast("double") * F.col("m")).alias("q"), F.count("*").alias("c"))
        apart = materialize(sizes.filter("c > 1").select("k", "m", ((F.col("m") * F.col("m") - F.col("q")) / 2).alias("pairs")), "apart")
        members, pairs = apart.agg(F.sum("m"), F.sum("pairs")).first()
        if not members:
            return roots
        own = rooted.join(apart.select("k"), "k", "left_semi")
        last = turn == ROUNDS or pairs <= PAIRS * members
        if last:
            met = all_pairs(own, sets, similarity)
        else:
            # The member in the middle of its group and any one, then others each turn.
            item = F.struct("node", "n", "r")
            one = lambda *x: F.min_by(item, F.xxhash64("node", F.lit(turn), *x))
            fixed = own.groupBy("k").agg(F.array(F.max_by(item, F.struct("w", "node")) if turn % 2 == 0 else one(), one("k")).alias("os"))
            met = own.join(fixed, "k").select("k", "node", "n", "r", F.explode("os").alias("o"))
            met = met.filter((F.col("r") != F.col("o.r")) & (F.least("n", "o.n") >= F.greatest("n", "o.n") * similarity - 1e-9))
            first = F.col("node") < F.col("o.node")
            pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
            met = met.select(pick("node", "o.node").alias("a"), pick("o.node", "node").alias("b"), pick("r", "o.r").alias("fa"), pick("o.r", "r").alias("fb")).distinct()
        found = verified(met, sets, similarity, sketches=not last).select(F.col("fa").alias("a"), F.col("fb").alias("b")).distinct()
        joined = materialize(components(found), "joined")
        old = roots.join(joined.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = materialize(old.unionByName(joined), "roots")
        if last:
            return roots


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, similarity: float = 0.8) -> DataFrame:
    """id, node (the text's digest), root (the same for all rows of a group) and component_id of every row."""
    rows = materialize(profiles(docs, id_col, text_col, shingle, similarity), "profiles")
    keys = materialize(shared_keys(rows.select("node", "fp", "n", "bands", "short").dropDuplicates(["node"]), similarity), "keys")
    sets = materialize(shingle_sets(docs, materialize(keys.select("node").distinct(), "nodes"), text_col, similarity), "sets")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = similar_links(keys, sets, links(classes.select("fp"), bits), similarity).withColumnRenamed("node", "of")
    rooted = classes.join(roots, F.col("fp") == F.col("of"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(whole, "root").select("fp", "root", "component_id")
    return join_hot(rows.select("id", "fp", "node"), named, "fp").select("id", "node", "root", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id of every row, as simhash.near_duplicates, with links of fingerprints within ``bits`` or five-word likeness of ``similarity``.

    Null and empty texts are one group; null ids count in no minimum; repeated rows stay; an empty table gives no rows.
    """
    groups = near_groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, bits=bits, similarity=similarity)
    return groups.select(F.col("id").alias("doc_id"), "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near_duplicates, in the same columns: see simhash.keep_first."""
    return keep_first(docs, near_groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, bits=bits, similarity=similarity), id_col, text_col)
