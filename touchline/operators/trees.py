"""Decision trees over histograms: soft-max boosting by second derivatives, symmetric trees, and forests, grown level by level on all rows.

1. Features become bins: cuts at up to ``bins`` - 1 exact quantiles, one byte a feature and row; the last bin is for nulls.
2. One pass a level, for all trees that grow side by side: each task sums its rows' statistics by (tree, node, feature, bin) in dense arrays, Spark adds the
   sums of all tasks by those keys, and each node's best split is found where its sums meet. Only splits reach the driver, one row a node.
3. Rows keep no state between levels: their nodes follow from the trees so far, which are broadcast, so a lost task repeats nothing else.
4. A node of at most ``SMALL`` rows is finished apart: its rows are dealt to the group of that tree and node, which grows all below it, level by level, by
   the same sums and the same choice of splits. So a large table takes a few passes, and the many nodes far down are one shuffle.

A model is a table of nodes (tree, node, feature, cut, children, counts, values), whichever method grew it; predictions are a walk over it, by arrays
in tasks (``TreeModel.scores``), by joins (``TreeModel.walked``), or, for forests of more than ``MOST_NODES`` nodes, which the driver never holds, by groups of
rows that meet the part of a tree that they lead to (``TreeModel.scored``).
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from touchline.operators import ranges
from touchline.sources import files

#: Bins of a feature without that for nulls: a power of two, so that the quantiles' shares are exact.
BINS = 64
#: Relative rank error of the first look at quantiles is one in so many: with fewer values it is exact.
ACCURACY = 10_000
#: A split has to gain so much; gains that agree to these places are equal, and the first feature and bin win.
LEAST_GAIN, PLACES = 1e-6, 7
#: Sums (tree, node, feature, bin) that a pass over the rows has at most: further nodes of the level wait for the next pass.
MOST_SUMS = 2_000_000
#: Rows of a node from which on it is split by passes over all rows; below, the group of its rows grows what is under it.
SMALL = 131_072
#: Cells (statistic, node, feature, bin) that such a group sums at one time.
MOST_CELLS = 4_000_000
#: Bytes of rows in a batch that is dealt to groups, about.
DEALT_BYTES = 8 << 20
#: Rows that a group of those to be predicted has at most, about.
BLOCK_ROWS = 1_000_000
#: Nodes of a forest that the driver holds at most; larger ones stay a written table.
MOST_NODES = 500_000
#: Rounds of boosting after which the rows' margins are kept, instead of walking all trees again for each level.
KEEP_ROUNDS = 10
#: Cumulated chances of 0 to 6 copies of a row in a bootstrap sample, for large tables: Poisson with mean one.
COPIES = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(7)])
#: Arrays of a grown part of a tree, by their names and types, in columns of bytes.
ARRAYS = {"feature": np.int32, "bin": np.int32, "nulls_left": np.bool_, "left": np.int32, "n": np.int64, "weight": np.float64, "gain": np.float64, "values": np.float64, "depth": np.int32}
GROWN = "tree int, node int, size long, deepest int, " + ", ".join(f"{c} binary" for c in ARRAYS)
NODES = "tree int, node int, feature string, cut double, nulls_left boolean, left int, right int, n long, weight double, gain double, values array<double>"


@dataclass
class Tree:
    """Nodes by number, the root first; feature -1 is a leaf. A row goes left (to ``left``, else to the next number) where its bin is at most ``bin``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    nulls_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    n: list[int] = field(default_factory=lambda: [0])
    weight: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    values: list[list[float]] = field(default_factory=lambda: [[0.0]])
    #: Path from the root, a bit a level behind a one: what features are drawn by.
    path: list[int] = field(default_factory=lambda: [1])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, at: int, nulls_left: bool, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.nulls_left[node], self.gain[node], self.left[node] = feature, at, nulls_left, gain, len(self.feature)
        for right in (0, 1):
            for own, value in ((self.feature, -1), (self.bin, 0), (self.nulls_left, True), (self.left, -1), (self.n, 0), (self.weight, 0.0), (self.gain, 0.0), (self.values, [0.0])):
                own.append(value)
            self.path.append(2 * self.path[node] + right)
            self.depth.append(self.depth[node] + 1)
        return self.left[node], self.left[node] + 1

    def graft(self, parts: list[tuple[int, dict[str, np.ndarray]]]) -> None:
        """Puts grown parts in place of the leaves of those numbers; the tree is arrays from then on."""
        size = len(self.feature)
        if size == 1:
            self.__dict__.update(parts[0][1], path=[])
            return
        joined = {c: [np.array(getattr(self, c), t)] for c, t in ARRAYS.items()}
        for node, own in parts:
            left = np.where(own["left"] >= 0, own["left"] + size - 1, -1)
            for c, into in joined.items():
                array = left if c == "left" else own[c]
                into[0][node] = array[0]
                into.append(array[1:])
            size += len(left) - 1
        for c, into in joined.items():
            setattr(self, c, np.concatenate(into))
        self.path = []

    def arrays(self) -> tuple:
        return np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.nulls_left), np.array(self.left, np.int32), np.array(self.values)


def leaves(tree: tuple, bins: np.ndarray, null_bin: int) -> np.ndarray:
    """The node that each row of bins ends in."""
    feature, at, nulls_left, left, _ = tree
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        own = feature[node]
        inner = own >= 0
        if not inner.any():
            return node
        b = bins[rows, np.maximum(own, 0)]
        right = np.where(b == null_bin, ~nulls_left[node], b > at[node])
        node = np.where(inner, left[node] + right, node)


def find_cuts(rows: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Distinct quantiles of each feature: of n values those of rank ceil(i n / bins). A column of nulls has none.

    One pass gives those of features with fewer values than ACCURACY; for the others it gives ranges to look in.
    """
    shares = [i / bins for i in range(1, bins)]
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in names]
    got = rows.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(f"c{i}") for i, c in enumerate(clean)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(clean)]).first()
    cuts = {i: sorted(set(got[f"c{i}"] or [])) for i in range(len(names))}
    large = {i: got[f"n{i}"] for i in cuts if got[f"n{i}"] >= ACCURACY}
    if large:
        cuts |= exact_cuts(rows.select(*[clean[i].alias(str(i)) for i in large]), {i: cuts[i] for i in large}, large, bins)
    return [cuts[i] for i in range(len(names))]


def exact_cuts(rows: DataFrame, near: dict[int, list[float]], counts: dict[int, int], bins: int) -> dict[int, list[float]]:
    """The quantiles of columns named by number, of so many values, from values near them.

    Values are counted, and summed over ranges between the near ones, so no task has all values of a column; a rank lies in what a value's count adds.
    """
    by_column = lambda values: F.create_map(*[x for i, own in values.items() for x in (F.lit(str(i)), F.array(*map(F.lit, own)))])[F.col("f")]
    each = rows.unpivot([], rows.columns, "f", "v").filter("v is not null").groupBy("f", "v").agg(F.count("*").alias("n"))
    part = F.size(F.filter(by_column(near), lambda x: x < F.col("v")))
    upto = ranges.prefix_sums(each, ["f"], part, ["v"], {"before": F.col("n")})
    ranks = {i: sorted({max(1, -(-j * n // bins)) for j in range(1, bins)}) for i, n in counts.items()}
    found = upto.filter(F.exists(by_column(ranks), lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("n")))).select("f", "v").collect()
    return {i: sorted(r["v"] for r in found if r["f"] == str(i)) for i in near}


def binned_values(values: np.ndarray, cuts: list[list[float]], null_bin: int) -> np.ndarray:
    """Bins of rows of features: how many cuts are below the value."""
    out = np.empty(values.shape, np.uint8)
    for i, own in enumerate(cuts):
        out[:, i] = np.where(np.isnan(values[:, i]), null_bin, np.searchsorted(own, values[:, i], side="left"))
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of doubles of one length; nulls are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def feature_array(names: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in names])


def binned(rows: DataFrame, names: list[str], cuts: list[list[float]], null_bin: int, id_col: str, label_col: str) -> DataFrame:
    """id (a hash), label and bins of rows with a label."""
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    @arrow_udf("binary")
    def put(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = binned_values(matrix(column, len(shared.value)), shared.value, null_bin)
            width = out.shape[1]
            ends = pa.py_buffer(np.arange(0, out.size + 1, width, dtype=np.int32)) if width else pa.py_buffer(np.zeros(len(out) + 1, np.int32))
            yield pa.Array.from_buffers(pa.binary(), len(out), [None, ends, pa.py_buffer(out.tobytes())])

    return rows.filter(F.col(label_col).isNotNull()).select(F.xxhash64(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), put(feature_array(names)).alias("bins"))


def bins_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The bins of a batch as a matrix."""
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("bins")).to_pylist()), np.uint8).reshape(-1, width)


#: What a method sums: (rows' weights of each statistic) for a tree, from a batch. None leaves the rows of that tree out.
Stats = Callable[[pa.RecordBatch, np.ndarray, int], np.ndarray]


def sums(data: DataFrame, width: int, null_bin: int, n_stats: int, frontier: list[tuple[int, list[int]]], trees: dict[int, Tree], make_stats: Callable[[], Stats], dense: bool = False) -> DataFrame:
    """tree, node, feature, bin and s0, s1 ... over all rows, for the frontier's nodes. dense: also the empty bins, of all nodes of a tree."""
    shared = data.sparkSession.sparkContext.broadcast([(t, nodes, trees[t].arrays()) for t, nodes in frontier])
    names = [f"s{i}" for i in range(n_stats)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, own = make_stats(), shared.value
        held = [np.zeros((n_stats, len(nodes) * width * (null_bin + 1))) for _, nodes, _ in own]
        offset = np.arange(width) * (null_bin + 1)
        for batch in batches:
            bins = bins_of(batch, width)
            for (t, nodes, tree), into in zip(own, held, strict=True):
                slot = np.full(len(tree[0]), -1, np.int64)
                slot[nodes] = np.arange(len(nodes))
                at = slot[leaves(tree, bins, null_bin)]
                value = stats(batch, bins, t)
                live = (at >= 0) & (value[-1] > 0)
                if not live.any():
                    continue
                key = (at[live, None] * (width * (null_bin + 1)) + offset[None, :] + bins[live]).ravel()
                for i in range(n_stats):
                    into[i] += np.bincount(key, np.repeat(value[i][live], width), into.shape[1])
        for (t, nodes, _), into in zip(own, held, strict=True):
            full = np.arange(into.shape[1]) if dense else np.flatnonzero(into[-1])
            cell, b = np.divmod(full, null_bin + 1)
            node, feature = np.divmod(cell, width)
            columns = [pa.array(np.full(len(full), t, np.int32)), pa.array(np.array(nodes, np.int32)[node] if len(nodes) else node.astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(b.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x[full]) for x in into]], names=["tree", "node", "feature", "bin", *names])

    rows = data.mapInArrow(run, "tree int, node int, feature int, bin int, " + ", ".join(f"{s} double" for s in names))
    return rows.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(s).alias(s) for s in names])


#: scores(left, right): the worth of both sides' statistics, and whether the split is allowed; arrays are (statistic, ...).
Scores = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
SPLIT = "tree int, node int, feature int, bin int, nulls_left boolean, gain double, total array<double>, lower array<double>, upper array<double>"


def best_splits(cells: DataFrame, width: int, null_bin: int, n_stats: int, scores: Scores, symmetric: bool = False, chosen: Callable[[int, int, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """A row a node: its sums, and the feature, bin and side of nulls of the largest gain (feature -1: none is allowed); symmetric: one split for all nodes of a tree.

    chosen(tree, node, which features vary) are the features that may be used.
    """

    def best(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy()
        tree = int(col("tree")[0])
        nodes, at = np.unique(col("node"), return_inverse=True)
        own = np.zeros((n_stats, len(nodes), width, null_bin + 1))
        own[:, at, col("feature"), col("bin")] = np.array([col(f"s{i}") for i in range(n_stats)])
        total = own.sum(-1)
        nulls, upto = own[..., null_bin], own[..., :null_bin].cumsum(-1)
        allowed = np.ones((len(nodes), width), bool)
        if chosen:
            for i, node in enumerate(nodes):
                varies = (own[-1, i] > 0).sum(-1) > 1
                allowed[i] = chosen(tree, int(node), varies)
        gains, sides = [], []
        before = scores(total, np.zeros_like(total))[0][..., None]
        for nulls_left in (True, False):
            left = upto + nulls[..., None] * nulls_left
            right = total[..., None] - left
            worth, ok = scores(left, right)
            gain = worth - before
            if symmetric:
                gains.append(np.round(gain.sum(0), PLACES))
            else:
                gains.append(np.where(ok & allowed[..., None], np.round(gain, PLACES), -np.inf))
            sides.append(left)
        rows = []
        for i, node in enumerate(nodes.tolist()):
            g = [x if symmetric else x[i] for x in gains]
            where = [int(np.argmax(x)) for x in g]
            peak = [x.flat[w] for x, w in zip(g, where, strict=True)]
            side = int(peak[1] > peak[0])
            f, b = divmod(where[side], null_bin)
            sound = peak[side] > LEAST_GAIN
            left = sides[side][:, i, f, b]
            whole = total[:, i, 0]
            rows.append((tree, node, f if sound else -1, b, not side, float(peak[side]) if sound else 0.0, whole.tolist(), left.tolist(), (total[:, i, f] - left).tolist()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), *[pa.list_(pa.float64())] * 3)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tree", "node", "feature", "bin", "nulls_left", "gain", "total", "lower", "upper"])

    return cells.groupBy(*["tree"] if symmetric else ["tree", "node"]).applyInArrow(best, SPLIT)


#: unpacked(extra bytes of rows, number of rows): their statistics, as (statistic, row).
Unpacked = Callable[[bytes, int], np.ndarray]


def grow(bins: np.ndarray, stats: np.ndarray, null_bin: int, scores: Scores, settled: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], divisible: Callable[[np.ndarray], np.ndarray], *,
         depth: int | None, symmetric: bool = False, path: int = 1, drawn: Callable[[int, np.ndarray], np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The arrays (see ARRAYS) of the tree under a node, from all of its rows: the same choice of splits as best_splits, for all nodes of a level at once.

    settled(totals) gives nodes' rows, weights and values, divisible(totals) which may be split; depth: levels left; drawn(path, which vary): features that may be used.
    """
    (n_stats, _), width = stats.shape, bins.shape[1]
    out: dict[str, list[np.ndarray]] = {c: [] for c in ARRAYS}
    first = path.bit_length() - 1
    order, slot, paths, made, level = np.arange(len(bins)), np.zeros(len(bins), np.int64), [path], 1, 0
    while paths:
        m = len(paths)
        total = np.array([np.bincount(slot, stats[i, order], m) for i in range(n_stats)])
        own = {c: np.zeros(m, t) for c, t in ARRAYS.items() if c != "values"}
        own["n"], own["weight"], own["values"] = settled(total)
        own["feature"][:], own["left"][:], own["nulls_left"][:], own["depth"][:] = -1, -1, True, first + level
        may = divisible(total) if depth is None or level < depth else np.zeros(m, bool)
        if symmetric and may.any():
            may[:] = True
        nodes = np.flatnonzero(may)
        ends = np.searchsorted(slot, np.arange(m + 1))
        per = width
        if drawn:
            allowed = []
            for i in nodes.tolist():
                x = bins[order[ends[i] : ends[i + 1]]]
                allowed.append(np.flatnonzero(drawn(paths[i], x.min(0) != x.max(0))))
            per = max(map(len, allowed), default=0)
        step = len(nodes) if symmetric else max(1, MOST_CELLS // max(1, n_stats * per * (null_bin + 1)))
        for start in range(0, len(nodes) if per else 0, max(1, step)):
            part = nodes[start : start + step]
            if drawn:
                chosen = np.full((len(part), per), -1)
                for i, f in enumerate(allowed[start : start + step]):
                    chosen[i, : len(f)] = f
            else:
                chosen = np.broadcast_to(np.arange(width), (len(part), width))
            of = np.full(m, -1)
            of[part] = np.arange(len(part))
            a, b = ends[part[0]], ends[part[-1] + 1]
            at, rows = of[slot[a:b]], order[a:b]
            at, rows = at[at >= 0], rows[at >= 0]
            key = ((at[:, None] * per + np.arange(per)[None, :]) * (null_bin + 1) + bins[rows[:, None], np.maximum(chosen, 0)[at]]).ravel()
            cells = np.array([np.bincount(key, np.repeat(stats[i, rows], per), len(part) * per * (null_bin + 1)) for i in range(n_stats)]).reshape(n_stats, len(part), per, null_bin + 1)
            nulls, upto = cells[..., null_bin], cells[..., :null_bin].cumsum(-1)
            whole = total[:, part][:, :, None, None]
            before = scores(whole, np.zeros_like(whole))[0]
            best = None
            for nulls_left in (True, False) if nulls.any() else (True,):
                left = upto + nulls[..., None] * nulls_left
                worth, ok = scores(left, whole - left)
                gain = worth - before
                gain = np.round(gain.sum(0), PLACES)[None] if symmetric else np.where(ok & (chosen >= 0)[..., None], np.round(gain, PLACES), -np.inf)
                gain = gain.reshape(len(gain), -1)
                where = gain.argmax(1)
                peak = gain[np.arange(len(gain)), where]
                if best is None:
                    best = [peak, where, np.ones(len(gain), bool)]
                else:
                    more = peak > best[0]
                    best = [np.where(more, new, old) for new, old in zip((peak, where, np.zeros(len(gain), bool)), best, strict=True)]
            peak, where, nulls_left = (np.broadcast_to(x, len(part)) for x in best)
            sound = peak > LEAST_GAIN
            f, cut = np.divmod(where, null_bin)
            split = part[sound]
            own["feature"][split] = chosen[np.arange(len(part)), f][sound]
            own["bin"][split], own["nulls_left"][split], own["gain"][split] = cut[sound], nulls_left[sound], peak[sound]
        split = np.flatnonzero(own["feature"] >= 0)
        own["left"][split] = made + 2 * np.arange(len(split))
        made += 2 * len(split)
        rank = np.full(m, -1)
        rank[split] = np.arange(len(split))
        live = rank[slot] >= 0
        order, slot = order[live], slot[live]
        b = bins[order, own["feature"][slot]]
        right = np.where(b == null_bin, ~own["nulls_left"][slot], b > own["bin"][slot])
        slot = 2 * rank[slot] + right
        sort = np.argsort(slot, kind="stable")
        order, slot = order[sort], slot[sort]
        paths = [2 * paths[i] + side for i in split.tolist() for side in (0, 1)]
        for c, array in own.items():
            out[c].append(array)
        level += 1
    return {c: np.concatenate(arrays) for c, arrays in out.items()}


#: pack(batch, bins, tree): which rows take part, and a function that gives the extra bytes of some.
Packed = Callable[[pa.RecordBatch, np.ndarray, int], tuple[np.ndarray, Callable[[np.ndarray], bytes]]]
DEALT = "tree int, node int, path string, bins binary, extra binary"


def in_batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows with bytes in the last two columns, in batches of some DEALT_BYTES."""
    out, size = [], 0
    for row in itertools.chain(rows, [None]):
        if row is not None:
            out.append(row)
            size += len(row[-1]) + len(row[-2])
        if out and (row is None or size >= DEALT_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))
            out, size = [], 0


def dealt(data: DataFrame, width: int, null_bin: int, roots: dict[int, list[int]], trees: dict[int, Tree], make_pack: Callable[[], Packed]) -> DataFrame:
    """Rows that lead to the roots, with their bins and extra bytes: a row a batch and root."""
    own = [(t, [(i, str(trees[t].path[i])) for i in nodes], trees[t].arrays()) for t, nodes in sorted(roots.items())]
    shared = data.sparkSession.sparkContext.broadcast(own)
    kinds = {"tree": pa.int32(), "node": pa.int32(), "path": pa.string(), "bins": pa.binary(), "extra": pa.binary()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        pack = make_pack()
        for batch in batches:
            bins = bins_of(batch, width)
            for t, nodes, tree in shared.value:
                live, extra = pack(batch, bins, t)
                at = leaves(tree, bins, null_bin)
                for node, path in nodes:
                    rows = np.flatnonzero(live & (at == node))
                    if len(rows):
                        yield t, node, path, bins[rows].tobytes(), extra(rows)

    return data.mapInArrow(lambda batches: in_batches(each(batches), kinds), DEALT)


def grown(rows: DataFrame, width: int, unpacked: Unpacked, grow_part: Callable[[int, str, np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """GROWN: what is below each root of dealt rows, by grow_part(tree, path, bins, statistics)."""

    def finish(table: pa.Table) -> pa.Table:
        whole = lambda c: [x.as_py() for x in table.column(c)]
        tree, node, path = (whole(c)[0] for c in ("tree", "node", "path"))
        # Batches come in any order; sums of floats follow that of the rows, so it is fixed.
        both = sorted(zip(whole("bins"), whole("extra"), strict=True))
        bins = np.frombuffer(b"".join(x for x, _ in both), np.uint8).reshape(-1, width)
        out = grow_part(tree, path, bins, np.concatenate([unpacked(y, len(x) // width) for x, y in both], axis=1))
        columns = [pa.array([tree], pa.int32()), pa.array([node], pa.int32()), pa.array([len(out["left"])], pa.int64()), pa.array([int(out["depth"].max())], pa.int32())]
        return pa.Table.from_arrays([*columns, *[pa.array([out[c].astype(t).tobytes()], pa.binary()) for c, t in ARRAYS.items()]], names=["tree", "node", "size", "deepest", *ARRAYS])

    return rows.groupBy("tree", "node").applyInArrow(finish, GROWN)


def part_of(row) -> dict[str, np.ndarray]:
    """The arrays of a grown part."""
    size = row["size"]
    out = {c: np.frombuffer(row[c], t) for c, t in ARRAYS.items()}
    return out | {"values": out["values"].reshape(size, -1)}


@dataclass
class TreeModel:
    """Trees over named features. kind mean: leaf values are class shares, averaged; kind sum: tree i adds to the margin of class i modulo their number."""

    names: list[str]
    cuts: list[list[float]]
    kind: str
    classes: int
    trees: list[Tree]
    null_bin: int = BINS
    #: GROWN: what stands in place of each leaf of ``trees``, where that is too much for the driver.
    below: DataFrame | None = None

    def put_below(self, parts: DataFrame, roots: dict[int, list[int]]) -> None:
        """Puts grown parts in place of leaves: within the trees where that is little, else as a written table with a part for each leaf."""
        below = files.written(parts)
        size = below.agg(F.sum("size")).first()[0] or 0
        if size <= MOST_NODES:
            own: dict[int, list] = {}
            for row in below.collect():
                own.setdefault(row["tree"], []).append((row["node"], part_of(row)))
            for t, each in own.items():
                self.trees[t].graft(sorted(each, key=lambda x: x[0]))
            files.discard(below)
            return
        ends = []
        for t, tree in enumerate(self.trees):
            for i in sorted({i for i, f in enumerate(tree.feature) if f < 0} - set(roots.get(t, []))):
                one = [np.array([getattr(tree, c)[i]], kind).tobytes() for c, kind in ARRAYS.items()]
                ends.append((t, i, 1, tree.depth[i], *map(bytearray, one)))
        self.below = files.written(below.unionByName(below.sparkSession.createDataFrame(ends, GROWN))) if ends else below

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The table of nodes: all of the model but its feature list. A leaf has neither feature nor children; ``cut`` is a value of the feature."""
        rows = []
        for t, tree in enumerate(self.trees):
            for i, f in enumerate(tree.feature):
                inner = f >= 0
                if not inner and self.below is not None:
                    continue
                # A split behind the last cut parts nulls from all other rows.
                cut = (self.cuts[f][tree.bin[i]] if tree.bin[i] < len(self.cuts[f]) else math.inf) if inner else None
                rows.append((t, i, self.names[f] if inner else None, cut, bool(tree.nulls_left[i]) if inner else None, int(tree.left[i]) if inner else None, int(tree.left[i]) + 1 if inner else None, int(tree.n[i]), float(tree.weight[i]), float(tree.gain[i]), [float(x) for x in tree.values[i]]))
        top = spark.createDataFrame(rows, NODES)
        return top if self.below is None else top.unionByName(self._nodes_below())

    def _nodes_below(self) -> DataFrame:
        names, cuts, sizes = self.names, self.cuts, [len(t.feature) for t in self.trees]
        before = F.sum(F.col("size") - 1).over(Window.partitionBy("tree").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for batch in batches for r in batch.to_pylist()):
                own = part_of(row)
                base = sizes[row["tree"]] + (row["before"] or 0) - 1
                number = np.arange(row["size"]) + base
                number[0] = row["node"]
                for start in range(0, row["size"], 10_000):
                    at = slice(start, start + 10_000)
                    inner = own["feature"][at] >= 0
                    pick = lambda values, inner=inner: [v if i else None for v, i in zip(values, inner.tolist(), strict=True)]
                    cut = [cuts[f][b] if b < len(cuts[f]) else math.inf for f, b in zip(np.maximum(own["feature"][at], 0).tolist(), own["bin"][at].tolist(), strict=True)]
                    left = (own["left"][at] + base).tolist()
                    columns = [
                        pa.array(np.full(len(inner), row["tree"], np.int32)), pa.array(number[at].astype(np.int32)), pa.array(pick([names[f] for f in own["feature"][at].tolist()]), pa.string()), pa.array(pick(cut), pa.float64()),
                        pa.array(pick(own["nulls_left"][at].tolist()), pa.bool_()), pa.array(pick(left), pa.int32()), pa.array(pick([x + 1 for x in left]), pa.int32()),
                        pa.array(own["n"][at]), pa.array(own["weight"][at]), pa.array(own["gain"][at]), pa.array(own["values"][at].tolist(), pa.list_(pa.float64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODES.split(", ")])

        # Few rows at a time: a part has some MB.
        return self.below.withColumn("before", before).mapInArrow(run, NODES)

    @staticmethod
    def of(nodes: DataFrame, names: list[str], kind: str, classes: int) -> TreeModel:
        """A model from its table of nodes: cuts are those that nodes use."""
        rows = nodes.orderBy("tree", "node").collect()
        cuts = [sorted({r["cut"] for r in rows if r["feature"] == name}) for name in names]
        at = [{c: i for i, c in enumerate(own)} for own in cuts]
        model = TreeModel(names, cuts, kind, classes, [], max([len(c) for c in cuts], default=0) + 1)
        for r in rows:
            if r["node"] == 0:
                model.trees.append(Tree(*[[] for _ in range(10)]))
            tree, f = model.trees[-1], names.index(r["feature"]) if r["feature"] is not None else -1
            for own, value in ((tree.feature, f), (tree.bin, at[f][r["cut"]] if f >= 0 else 0), (tree.nulls_left, bool(r["nulls_left"])), (tree.left, r["left"] if f >= 0 else -1), (tree.n, r["n"]), (tree.weight, r["weight"]), (tree.gain, r["gain"]), (tree.values, list(r["values"]))):
                own.append(value)
        return model

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """Rows by classes: summed margins, or mean shares."""
        out = np.zeros((len(bins), self.classes))
        for t, tree in enumerate(self.trees):
            own = tree.arrays()
            got = own[4][leaves(own, bins, self.null_bin)]
            if self.kind == "sum":
                out[:, t % self.classes] += got[:, 0]
            else:
                out += got / len(self.trees)
        return out

    def scores(self) -> Column:
        """array<double> of class probabilities of a row with the features; unknown values are null or NaN."""
        shared = self

        @arrow_udf("array<double>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                got = shared.margins(binned_values(matrix(column, len(shared.names)), shared.cuts, shared.null_bin))
                p = softmax(got) if shared.kind == "sum" else got
                yield pa.array(p.tolist(), pa.list_(pa.float64()))

        return run(feature_array(self.names))

    def scored(self, rows: DataFrame, id_col: str) -> DataFrame:
        """id (a long, unique) and scores() of a model of many nodes: rows go to the part of each tree that they lead to; its leaves' shares are summed by id."""
        width, null_bin, cuts, blocks = len(self.names), self.null_bin, self.cuts, -(-rows.count() // BLOCK_ROWS) or 1
        shared = rows.sparkSession.sparkContext.broadcast([t.arrays() for t in self.trees])
        names = [f"s{k}" for k in range(self.classes)]
        kinds = {"tree": pa.int32(), "node": pa.int32(), "block": pa.int64(), "ids": pa.binary(), "bins": pa.binary()}

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for i, batch in enumerate(batches, TaskContext.get().partitionId()):
                ids, bins = batch.column(0).to_numpy(), binned_values(matrix(batch.column(1), width), cuts, null_bin)
                for t, tree in enumerate(shared.value):
                    at = leaves(tree, bins, null_bin)
                    for node in np.unique(at).tolist():
                        yield t, node, i % blocks, ids[at == node].tobytes(), bins[at == node].tobytes()

        def shares_of(own: pa.Table, parts: pa.Table) -> pa.Table:
            if not len(own):
                return pa.table({"id": pa.array([], pa.int64())} | {s: pa.array([], pa.float64()) for s in names})
            part = part_of(parts.to_pylist()[0])
            ids = np.frombuffer(b"".join(x.as_py() for x in own.column("ids")), np.int64)
            bins = np.frombuffer(b"".join(x.as_py() for x in own.column("bins")), np.uint8).reshape(-1, width)
            got = part["values"][leaves(tuple(part[c] for c in ("feature", "bin", "nulls_left", "left", "values")), bins, null_bin)]
            return pa.table({"id": pa.array(ids)} | {s: pa.array(got[:, k]) for k, s in enumerate(names)})

        by = ["tree", "node", "block"]
        there = rows.select(F.col(id_col).cast("long"), feature_array(self.names)).mapInArrow(lambda batches: in_batches(each(batches), kinds), "tree int, node int, block long, ids binary, bins binary")
        parts = self.below.crossJoin(F.broadcast(rows.sparkSession.range(blocks).withColumnRenamed("id", "block")))
        got = there.groupBy(by).cogroup(parts.groupBy(by)).applyInArrow(shares_of, "id long, " + ", ".join(f"{s} double" for s in names))
        return got.groupBy(F.col("id").alias(id_col)).agg(F.array(*[F.sum(s) / len(self.trees) for s in names]).alias("scores"))

    def walked(self, rows: DataFrame, id_col: str = "match_id") -> DataFrame:
        """id and scores (margins or mean shares) by joins with the table of nodes, a level each: the same as scores(), as relations.

        Rows are taken once for each tree; nodes are model, so they are broadcast.
        """
        nodes = self.nodes(rows.sparkSession).select("tree", "node", "feature", "cut", "nulls_left", "left", "right", "values")
        nodes = F.broadcast(nodes) if self.below is None else nodes
        x = F.map_from_arrays(F.lit(self.names), feature_array(self.names))
        at = rows.select(F.col(id_col), x.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(len(self.trees) - 1))).alias("tree"), F.lit(0).alias("node"))
        deepest = max(max(t.depth) if len(t.depth) else depth_of(t) for t in self.trees)
        if self.below is not None:
            deepest = self.below.agg(F.max("deepest")).first()[0]
        value = F.nanvl(F.col("x")[F.col("feature")], F.lit(None))
        left = F.when(value.isNull(), F.col("nulls_left")).otherwise(value <= F.col("cut"))
        for _ in range(deepest):
            at = at.join(nodes, ["tree", "node"]).select(id_col, "x", "tree", F.when(F.col("feature").isNull(), F.col("node")).when(left, F.col("left")).otherwise(F.col("right")).alias("node"))
        ends = at.join(nodes, ["tree", "node"])
        if self.kind == "sum":
            each = [F.sum(F.when(F.col("tree") % self.classes == i, F.col("values")[0]).otherwise(0.0)) for i in range(self.classes)]
        else:
            each = [F.avg(F.col("values")[i]) for i in range(self.classes)]
        return ends.groupBy(id_col).agg(F.array(*each).alias("scores"))

    def importance(self) -> list[float]:
        """Gain of each feature's splits, as shares of one tree, averaged over trees (mean), or of the whole (sum)."""
        out = np.zeros(len(self.names))
        if self.below is not None:
            of_tree = self.nodes(self.below.sparkSession).filter("feature is not null").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
            for r in of_tree.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy("tree"))).groupBy("feature").agg(F.sum("share").alias("share")).collect():
                out[self.names.index(r["feature"])] = r["share"]
            return (out / (out.sum() or 1.0)).tolist()
        for tree in self.trees:
            own = np.zeros(len(self.names))
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    own[f] += g
            out += own / (own.sum() or 1.0) if self.kind == "mean" else own
        return (out / (out.sum() or 1.0)).tolist()


def depth_of(tree: Tree) -> int:
    depth = [0] * len(tree.feature)
    for i, left in enumerate(tree.left):
        if left >= 0:
            depth[left] = depth[left + 1] = depth[i] + 1
    return max(depth)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def newton(l2: float, least_weight: float) -> Scores:
    """Second-order gain: statistics are gradient, second derivative, rows."""

    def scores(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        worth = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2)
        sound = (left[1] >= least_weight) & (right[1] >= least_weight) & (np.round(left[2]) > 0) & (np.round(right[2]) > 0)
        return worth, sound

    return scores


def gradients(label: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by classes of the soft-max loss's first and (twice, as is usual) second derivatives."""
    p = softmax(margins)
    return p - (label[:, None] == np.arange(margins.shape[1])[None, :]), np.maximum(2 * p * (1 - p), 1e-16)


def fit_boosted(
    rows: DataFrame, names: list[str], *, classes: int = 3, rounds: int = 200, depth: int = 6, step: float = 0.3, l2: float = 1.0, least_weight: float = 1.0, bins: int = BINS,
    symmetric: bool = False, id_col: str = "match_id", label_col: str = "label",
) -> TreeModel:
    """Soft-max boosting: each round one tree a class, all from the same passes, with Newton leaves, and a learned side for nulls.

    symmetric: all nodes of a level share a split. Rows without a label take no part; without rows there is nothing to learn, and all classes are as likely.
    """
    cuts = find_cuts(rows, names, bins)
    model = TreeModel(names, cuts, "sum", classes, [], bins)
    width, n_stats = len(names), 3
    base = binned(rows, names, cuts, bins, id_col, label_col).persist()
    data, kept = base.withColumn("margins", F.array(*[F.lit(0.0)] * classes)), 0
    held: DataFrame | None = None

    def settled(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.round(total[2]), total[1], (-step * total[0] / (total[1] + l2))[:, None]

    def grow_part(tree: int, path: str, own: np.ndarray, stats: np.ndarray) -> dict[str, np.ndarray]:
        return grow(own, stats, bins, newton(l2, 0.0 if symmetric else least_weight), settled, lambda total: np.ones(total.shape[1], bool), depth=depth, symmetric=symmetric)

    def with_rows(extra: bytes, n: int) -> np.ndarray:
        return np.concatenate([np.frombuffer(extra).reshape(2, n), np.ones((1, n))])

    try:
        small = base.count() <= SMALL
        for r in range(rounds):
            if r and r % KEEP_ROUNDS == 0:
                last, shared = held, rows.sparkSession.sparkContext.broadcast(TreeModel(names, cuts, "sum", classes, list(model.trees), bins))

                def with_margins(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        got = shared.value.margins(bins_of(batch, width))
                        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got.tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "margins"])

                # From the bins, not from the margins before: lineage stays short, and a lost part costs one walk.
                data = held = base.mapInArrow(with_margins, "id long, label int, bins binary, margins array<double>").persist()
                data.count()
                if last is not None:
                    last.unpersist()
                kept = len(model.trees)
            later = TreeModel(names, cuts, "sum", classes, model.trees[kept:], bins)
            later_shared = rows.sparkSession.sparkContext.broadcast(later)

            def make_stats(later_shared=later_shared) -> Stats:
                known: dict = {}

                def stats(batch: pa.RecordBatch, bins: np.ndarray, tree: int) -> np.ndarray:
                    if known.get("of") is not batch:  # one walk a batch, for the trees of all classes
                        start = matrix(batch.column(batch.schema.get_field_index("margins")), classes)
                        g, h = gradients(batch.column(batch.schema.get_field_index("label")).to_numpy(), start + later_shared.value.margins(bins))
                        known.update(of=batch, g=g, h=h)
                    return np.array([known["g"][:, tree], known["h"][:, tree], np.ones(len(bins))])

                return stats

            trees = {c: Tree() for c in range(classes)}
            frontier = {c: [0] for c in range(classes)}
            if small:

                def make_pack(make_stats=make_stats) -> Packed:
                    stats = make_stats()

                    def pack(batch: pa.RecordBatch, bins: np.ndarray, tree: int) -> tuple[np.ndarray, Callable[[np.ndarray], bytes]]:
                        got = stats(batch, bins, tree)[:2]
                        return np.ones(len(bins), bool), lambda rows: got[:, rows].tobytes()

                    return pack

                for row in grown(dealt(data, width, bins, frontier, trees, make_pack), width, with_rows, grow_part).collect():
                    trees[row["tree"]] = Tree(**{c: x.tolist() for c, x in part_of(row).items()}, path=[])
            for level in range(0 if small else depth):
                cells = sums(data, width, bins, n_stats, sorted(frontier.items()), trees, make_stats, dense=symmetric)
                below: dict[int, list[int]] = {}
                for s in best_splits(cells, width, bins, n_stats, newton(l2, 0.0 if symmetric else least_weight), symmetric).collect():
                    tree, node = trees[s["tree"]], s["node"]
                    settle(tree, node, s["total"], step, l2)
                    if s["feature"] < 0:
                        continue
                    children = tree.split(node, s["feature"], s["bin"], s["nulls_left"], s["gain"])
                    for child, total in zip(children, (s["lower"], s["upper"]), strict=True):
                        settle(tree, child, total, step, l2)
                    below.setdefault(s["tree"], []).extend(children)
                frontier = {t: sorted(nodes) for t, nodes in below.items()}
                if not frontier or level == depth - 1:
                    break
            model.trees += [trees[c] for c in range(classes)]
            later_shared.destroy()
    finally:
        base.unpersist()
        if held is not None:
            held.unpersist()
    return model


def settle(tree: Tree, node: int, total: list[float], step: float, l2: float) -> None:
    tree.n[node], tree.weight[node], tree.values[node] = round(total[2]), total[1], [-step * total[0] / (total[1] + l2)]


def copies(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample: drawn by a hash of id, tree and seed, the same in every pass."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % (1 << 32)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(COPIES, (z >> np.uint64(11)).astype(float) / (1 << 53), side="right")


def drawn_features(seed: int, tree: int, path: int, varies: np.ndarray, n: int) -> np.ndarray:
    """The first n features that vary in a node, in an order drawn by seed, tree and the node's path."""
    order = sorted(np.flatnonzero(varies).tolist(), key=lambda f: hashlib.md5(f"{seed}|{tree}|{path}|{f}".encode()).digest())
    out = np.zeros(len(varies), bool)
    out[order[:n]] = True
    return out


def gini(classes: int, least_leaf: int) -> Scores:
    """Decrease of weighted impurity: statistics are the classes' weights, then distinct rows."""

    def scores(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = lambda x: (x[:classes] ** 2).sum(0) / np.maximum(x[:classes].sum(0), 1e-300)
        return side(left) + side(right), (np.round(left[-1]) >= least_leaf) & (np.round(right[-1]) >= least_leaf)

    return scores


def fit_forest(
    rows: DataFrame, names: list[str], *, classes: int = 3, trees: int = 100, depth: int | None = None, least_split: int = 2, least_leaf: int = 1, bins: int = BINS,
    bootstrap: bool = True, features_per_node: int | None = None, seed: int = 42, id_col: str = "match_id", label_col: str = "label",
) -> TreeModel:
    """A forest: bootstrap weights, sqrt(features) drawn for each node, nodes of fewer than ``least_split`` distinct rows stay leaves, no leaf of fewer than ``least_leaf``.

    depth None grows until leaves are pure or too small, so the model grows with the rows, and so does what the driver holds; bound it by least_leaf on large
    tables. Levels with more nodes than fit MOST_SUMS take several passes. Rows without a label take no part.
    """
    cuts = find_cuts(rows, names, bins)
    width, n_stats, per_node = len(names), classes + 1, features_per_node or max(1, math.isqrt(len(names)))
    grown_trees = {t: Tree() for t in range(trees)}
    data = binned(rows, names, cuts, bins, id_col, label_col).persist()

    def make_stats() -> Stats:
        def stats(batch: pa.RecordBatch, bins: np.ndarray, tree: int) -> np.ndarray:
            label, ids = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("label", "id"))
            w = copies(ids, tree, seed) if bootstrap else np.ones(len(ids))
            return np.array([*[np.where(label == c, w, 0.0) for c in range(classes)], (w > 0).astype(float)])

        return stats

    def make_pack() -> Packed:
        def pack(batch: pa.RecordBatch, bins: np.ndarray, tree: int) -> tuple[np.ndarray, Callable[[np.ndarray], bytes]]:
            label, ids = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("label", "id"))
            w = copies(ids, tree, seed) if bootstrap else np.ones(len(ids), np.int64)
            return w > 0, lambda rows: np.stack([label[rows], w[rows]]).astype(np.uint8).tobytes()

        return pack

    def unpacked(extra: bytes, n: int) -> np.ndarray:
        label, w = np.frombuffer(extra, np.uint8).reshape(2, n)
        return np.array([*[np.where(label == c, w, 0.0) for c in range(classes)], np.ones(n)])

    def settled(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weight = total[:classes].sum(0)
        return np.round(total[-1]), weight, (total[:classes] / weight).T

    def divisible(total: np.ndarray) -> np.ndarray:
        return ((total[:classes] > 0).sum(0) > 1) & (np.round(total[-1]) >= max(2, least_split))

    def grow_part(tree: int, path: str, own: np.ndarray, stats: np.ndarray) -> dict[str, np.ndarray]:
        at = int(path)
        levels = None if depth is None else depth - (at.bit_length() - 1)
        return grow(own, stats, bins, gini(classes, least_leaf), settled, divisible, depth=levels, path=at, drawn=lambda node, varies: drawn_features(seed, tree, node, varies, per_node))

    model = TreeModel(names, cuts, "mean", classes, [grown_trees[t] for t in range(trees)], bins)
    small: dict[int, list[int]] = {}
    try:
        frontier = []
        if data.count() <= SMALL:
            small = {t: [0] for t in range(trees)}
        else:
            frontier = [(t, 0) for t in range(trees)]
        level = 0
        while frontier:
            below, most = [], max(1, MOST_SUMS // (width * (bins + 1) * n_stats))
            for start in range(0, len(frontier), most):
                part = frontier[start : start + most]
                by_tree: dict[int, list[int]] = {}
                for t, node in part:
                    by_tree.setdefault(t, []).append(node)
                paths = {(t, node): grown_trees[t].path[node] for t, node in part}
                pick = lambda t, node, varies, paths=paths: drawn_features(seed, t, paths[t, node], varies, per_node)
                cells = sums(data, width, bins, n_stats, sorted(by_tree.items()), grown_trees, make_stats)
                for s in best_splits(cells, width, bins, n_stats, gini(classes, least_leaf), chosen=pick).collect():
                    tree, node = grown_trees[s["tree"]], s["node"]
                    shares(tree, node, s["total"], classes)
                    if s["feature"] < 0 or round(s["total"][-1]) < least_split:
                        continue
                    children = tree.split(node, s["feature"], s["bin"], s["nulls_left"], s["gain"])
                    for child, total in zip(children, (s["lower"], s["upper"]), strict=True):
                        shares(tree, child, total, classes)
                        impure = sum(x > 0 for x in total[:classes]) > 1
                        if impure and round(total[-1]) >= max(2, least_split) and (depth is None or level + 1 < depth):
                            if round(total[-1]) <= SMALL:
                                small.setdefault(s["tree"], []).append(child)
                            else:
                                below.append((s["tree"], child))
            frontier, level = sorted(below), level + 1
            if depth is not None and level >= depth:
                break
        if small:
            model.put_below(grown(dealt(data, width, bins, small, grown_trees, make_pack), width, unpacked, grow_part), small)
    finally:
        data.unpersist()
    if model.below is None:
        for tree in grown_trees.values():  # a table without rows
            if tree.weight[0] == 0:
                tree.values = [[1 / classes] * classes]
    return model


def shares(tree: Tree, node: int, total: list[float], classes: int) -> None:
    weight = sum(total[:classes])
    tree.n[node], tree.weight[node], tree.values[node] = round(total[-1]), weight, [x / weight for x in total[:classes]]
