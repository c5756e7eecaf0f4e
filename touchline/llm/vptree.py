"""Nearest neighbours by inner product: one vantage-point tree per shard, with relaxed triangle-inequality pruning.

Candidates are searched by length (number of components) and by band: norms within a factor of two. Within a band vectors are scaled by a power of two to norms
below 1 and queries to norm 1; one more coordinate, sqrt(1 - |x|^2) for candidates and 0 for queries, puts all on a unit sphere, so that the
largest product is the smallest distance and the triangle inequality holds. So no band's norms blur another's, however far apart they are: distances only
prune, and hits are ranked by the product of the original vectors.

1. Equal vectors collapse to one entry that keeps its k + 1 smallest ids (no query can return more of them), so a vector that
   a third of the rows share is searched once. The ids are picked per salt before they meet.
2. A bounded sample of the distinct vectors gives a small vantage-point tree for each band that it holds, on the driver; leaves are cells, any other band is one cell. Each cell is
   split by a hash of the id into blocks of about ``shard_rows`` vectors: a (cell, block) is a shard.
3. Each query searches the shards of its own cell of each band, then those of every other cell that the same relaxed bound, with the
   k-th product found so far, can't exclude. A cell's queries go in blocks of about ``query_rows``, and its shards are copied once for each block: what is shuffled grows with the pairs that are searched.
4. Within a shard, a subtree is skipped when its lower bound exceeds ``factor`` times the k-th distance so far: factor one is
   exact, smaller factors skip more.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import join_hot, materialize

#: Slack of distances on the unit sphere: those near zero are known to about 1e-8.
EPS = 1e-6
SALTS = 32
#: Products whose components are held at one time.
PRODUCTS = 1 << 14


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, all of norm 1."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _reach(s: np.ndarray) -> np.ndarray:
    """The distance within which products of norm-1 vectors are s or more; no product is more than 1, and a little for rounding."""
    return np.where(s > 1 + EPS, -np.inf, np.sqrt(2.0 - 2.0 * np.clip(s, -2.0, 1.0)))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two to norms from 0.5 to 1, and the exponents: row = scaled * 2 ** exponent. Nothing overflows or vanishes."""
    first = np.frexp(np.abs(vectors).max(1))[1]
    y = np.ldexp(vectors, -first[:, None])
    more = np.frexp(np.sqrt((y * y).sum(1)))[1]
    return np.ldexp(y, -more[:, None]), first + more


def lift(vectors: np.ndarray, band: int | None = None) -> np.ndarray:
    """Rows as points of the unit sphere: candidates of a band scaled to it, with one more coordinate; queries (band None) scaled to norm 1, with 0."""
    x, exponent = scaled(vectors)
    if band is None:
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(1.0 - (x * x).sum(1), 0.0))[:, None]], axis=1)


def in_band(score: np.ndarray, queries: np.ndarray, band: int) -> np.ndarray:
    """Products with the original vectors as products on the sphere of a band."""
    x, exponent = scaled(queries)
    with np.errstate(over="ignore", under="ignore"):
        return np.ldexp(score / np.sqrt((x * x).sum(1)), -(exponent + band))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of pairs of rows, summed in order, so that every plan gives the same last digit."""
    out = np.empty(len(q))
    for at in range(0, len(q), PRODUCTS):
        own = slice(at, at + PRODUCTS)
        out[own] = np.cumsum(q[own] * x[own], axis=1)[:, -1]
    return out


class VPTree:
    """A vantage-point tree over rows of norm 1. Nodes are ("leaf", rows) or ("node", vantage, [(lo, hi, child), ...])."""

    def __init__(self, points: np.ndarray, leaf: int = 128):
        self.points, self.leaf_rows = points, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf_rows:
            return ("leaf", rows)
        own = self.points[rows]
        vantage = own[int(np.argmin(own @ own.mean(0)))]
        d = _distances(own, vantage[None])[:, 0]
        inside = d <= np.median(d)
        if inside.all():  # only a few distances occur: the median is the largest
            inside = d < d.max()
        if not inside.any():
            return ("leaf", rows)
        return ("node", vantage, [(d[m].min(), d[m].max(), self._build(rows[m])) for m in (inside, ~inside)])

    def leaves(self) -> int:
        """Number the leaves from 0, in order; returns their count."""
        self.numbered = []

        def walk(node):
            if node[0] == "leaf":
                self.numbered.append(node)
                return ("leaf", node[1], len(self.numbered) - 1)
            return ("node", node[1], [(lo, hi, walk(c)) for lo, hi, c in node[2]])

        self.root = walk(self.root)
        return len(self.numbered)

    def search(self, queries: np.ndarray, keep: int, factor: float, least: np.ndarray, exact, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Query numbers, rows and scores of the ``keep`` best of each query, by exact score and then smaller id; pairs computed.

        exact(query numbers, rows): the scores by which rows rank, and these as products on the sphere. least: products (on the sphere) that are wanted of each query.
        """
        keep_s = np.full((len(queries), keep), -np.inf)  # exact scores, best first
        keep_u = np.full((len(queries), keep), -np.inf)  # the same as products on the sphere
        keep_r = np.full((len(queries), keep), -1, dtype=np.int64)
        slack = 8 * queries.shape[1] * np.finfo(float).eps
        pairs = 0

        def wanted(q: np.ndarray) -> np.ndarray:
            return np.maximum(keep_u[q, -1], least[q])

        def visit(node, active: np.ndarray) -> None:
            nonlocal pairs
            if not len(active):
                return
            if node[0] == "leaf":
                rows = node[1]
                pairs += len(active) * len(rows)
                near = queries[active] @ self.points[rows].T
                floor = wanted(active)
                if len(rows) > keep:  # at least as many of these rows come before any below
                    floor = np.maximum(floor, np.partition(near, len(rows) - keep, axis=1)[:, len(rows) - keep])
                i, j = np.nonzero(near >= (floor - slack)[:, None])
                if not len(i):
                    return
                own, row = active[i], rows[j]
                score, unit = exact(own, row)
                touched = np.unique(own)
                old = np.repeat(touched, keep)
                q, r = np.concatenate([old, own]), np.concatenate([keep_r[touched].ravel(), row])
                s, u = np.concatenate([keep_s[touched].ravel(), score]), np.concatenate([keep_u[touched].ravel(), unit])
                order = np.lexsort((np.where(r >= 0, ids[r], np.iinfo(np.int64).max), -s, r < 0, q))
                q, r, s, u = q[order], r[order], s[order], u[order]
                first = np.searchsorted(q, touched)
                at = first[:, None] + np.arange(keep)[None, :]
                keep_r[touched], keep_s[touched], keep_u[touched] = r[at], s[at], u[at]
                return
            _, vantage, children = node
            pairs += len(active)
            dq = _distances(queries[active], vantage[None])[:, 0]
            bounds = [np.maximum(np.maximum(lo - dq, dq - hi), 0.0) for lo, hi, _ in children]
            first = bounds[0] <= bounds[1]
            for order in ((0, 1), (1, 0)):
                mask = first if order[0] == 0 else ~first
                for side in order:
                    own, lb = active[mask], bounds[side][mask]
                    visit(children[side][2], own[lb <= factor * _reach(wanted(own)) + EPS])

        visit(self.root, np.arange(len(queries)))
        q, at = np.nonzero(keep_r >= 0)
        return q, keep_r[q, at], keep_s[q, at], pairs


def _route(tree: VPTree, points: np.ndarray) -> np.ndarray:
    """The cell of each point: the leaf that it falls in."""
    out = np.zeros(len(points), dtype=np.int64)

    def walk(node, rows):
        if not len(rows):
            return
        if node[0] == "leaf":
            out[rows] = node[2]
            return
        d = _distances(points[rows], node[1][None])[:, 0]
        mid = (node[2][0][1] + node[2][1][0]) / 2
        walk(node[2][0][2], rows[d <= mid])
        walk(node[2][1][2], rows[d > mid])

    walk(tree.root, np.arange(len(points)))
    return out


def _reachable(tree: VPTree, points: np.ndarray, reach: np.ndarray, factor: float) -> list[list[int]]:
    """The cells that the relaxed bound leaves to each point, given the distance that is wanted.

    A cell holds all points on its side of each midpoint, not only the sample's, so the bounds are the midpoints themselves.
    """
    out: list[list[int]] = [[] for _ in points]

    def walk(node, rows):
        if not len(rows):
            return
        if node[0] == "leaf":
            for r in rows:
                out[r].append(node[2])
            return
        d = _distances(points[rows], node[1][None])[:, 0]
        mid = (node[2][0][1] + node[2][1][0]) / 2
        walk(node[2][0][2], rows[np.maximum(d - mid, 0.0) <= factor * reach[rows] + EPS])
        walk(node[2][1][2], rows[np.maximum(mid - d, 0.0) <= factor * reach[rows] + EPS])

    walk(tree.root, np.flatnonzero(reach > -np.inf))
    return out


def _usable(v: Column) -> Column:
    """Vectors with components, all finite and not all zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0.0)


def nearest(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", query_every: int = 20, k: int = 20, factor: float = 1.0,
    shard_rows: int = 4096, query_rows: int = 8192, sample_rows: int = 4096, leaf: int = 128,
) -> DataFrame:
    """The k nearest rows of each query row (id divisible by ``query_every``): query_id, rank, vec_id, score.

    Null ids and vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of different lengths have no inner product: each is
    searched among those of its own length. Ties go to the smaller id; a repeated id never
    returns itself; an empty table gives no rows. ``sample_rows`` bounds the rows that the driver sees.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v")).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    few = rows.withColumn("salt", salt).dropDuplicates(["id", "v"])
    few = few.withColumn("rn", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).filter(F.col("rn") <= k + 1)
    entries = few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    entries = materialize(entries.withColumn("key", F.col("ids")[0]), "vectors")
    asked = materialize(rows.filter(F.col("id") % query_every == 0).select("id", "v", F.xxhash64("v").alias("digest")).distinct(), "asked")
    wanted = materialize(asked.groupBy("v").agg(F.min("id").alias("qkey")), "wanted")

    n = entries.count()
    sample = [np.array(r["v"]) for r in entries.orderBy(F.xxhash64("key", F.lit(7)), "key").limit(sample_rows).select("v").collect()]
    groups: dict[tuple[int, int], list[np.ndarray]] = {}
    for x in sample:
        groups.setdefault((len(x), int(scaled(x[None])[1][0])), []).append(x)
    share = math.ceil(n / shard_rows) / max(1, len(sample))  # shards for each row of the sample
    cells = {g: VPTree(lift(np.array(xs), g[1]), leaf=max(16, math.ceil(1 / share))) for g, xs in groups.items()}
    for tree in cells.values():
        tree.leaves()
        tree.points = None  # only vantages and bounds travel
    shared = spark.sparkContext.broadcast(cells)

    def placed(batches):
        for pdf in batches:
            if len(pdf):
                pdf["len"] = [len(x) for x in pdf["v"]]
                pdf["band"], pdf["cell"] = 0, 0
                for size, own in pdf.groupby("len"):
                    x = np.array(own["v"].tolist())
                    band = scaled(x)[1]
                    cell = np.zeros(len(x), dtype=np.int64)
                    for b in np.unique(band).tolist():
                        if tree := shared.value.get((size, b)):
                            cell[band == b] = _route(tree, lift(x[band == b], b))
                    pdf.loc[own.index, "band"], pdf.loc[own.index, "cell"] = band, cell
                yield pdf[["key", "v", "len", "band", "cell"]]

    place = ["len", "band", "cell"]
    stored = materialize(entries.select("key", "v").mapInPandas(placed, "key long, v array<double>, len int, band int, cell int"), "placed")
    blocks = stored.groupBy(*place).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("blocks"))
    blocks = materialize(blocks, "blocks")
    bands = blocks.select("len", "band").distinct()

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qkey": [], "key": [], "score": []})
        left = left.sort_values("key")
        x, q = np.array(left["v"].tolist()), np.array(right["v"].tolist())
        ids, band, keep = left["key"].to_numpy(), int(left["band"].iloc[0]), min(len(x), k + 1)
        # Products in the order of the original components; a scale by a power of two changes no digit.
        units, factors = in_band(np.ones(len(q)), q, band), right["tau"].to_numpy(dtype=float)
        with np.errstate(over="ignore", invalid="ignore"):
            least = np.where(np.isnan(factors), -np.inf, in_band(factors, q, band))

        def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            score = products(q[a], x[b])
            if not np.all(np.isfinite(units[a])) or np.any(units[a] == 0.0):
                return score, in_band(score, q[a], band)
            return score, score * units[a]

        at, row, score, _ = VPTree(lift(x, band), leaf=leaf).search(lift(q), keep, factor, least, exact, ids)
        return pd.DataFrame({"qkey": right["qkey"].to_numpy()[at], "key": ids[row], "score": score})

    def found(queries: DataFrame) -> DataFrame:
        """Hits of queries (qkey, v, tau and place): a cell's queries in blocks, its vectors in blocks, each pair of blocks once."""
        sizes = queries.groupBy(*place).agg(F.ceil(F.count("*") / query_rows).cast("int").alias("q_blocks")).join(blocks, place)
        mine = stored.join(sizes, place).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        theirs = queries.join(sizes, place).withColumn("q_block", F.pmod(F.xxhash64("qkey"), F.col("q_blocks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        on = [*place, "block", "q_block"]
        mine, theirs = mine.select("key", "v", *on), theirs.select("qkey", "v", "tau", *on)
        return mine.groupBy(*on).cogroup(theirs.groupBy(*on)).applyInPandas(search, "qkey long, key long, score double")

    def asks(batches):
        for pdf in batches:
            if len(pdf):
                pdf["cell"] = 0
                for g, own in pdf.groupby(["len", "band"]):
                    if tree := shared.value.get((int(g[0]), int(g[1]))):
                        pdf.loc[own.index, "cell"] = _route(tree, lift(np.array(own["v"].tolist())))
                yield pdf[["qkey", "v", *place]]

    def further(batches):
        for pdf in batches:
            if len(pdf):
                cells = pd.Series([[] for _ in range(len(pdf))], index=pdf.index, dtype=object)
                for g, own in pdf.groupby(["len", "band"]):
                    if tree := shared.value.get((int(g[0]), int(g[1]))):
                        q, tau = np.array(own["v"].tolist()), own["tau"].to_numpy(dtype=float)
                        s = np.where(np.isnan(tau), -2.0, in_band(tau, q, int(g[1])))
                        for i, home, reach in zip(own.index, own["cell"], _reachable(tree, lift(q), _reach(s), factor), strict=True):
                            cells[i] = [c for c in reach if c != home]
                pdf["cells"] = cells
                yield pdf[["qkey", "v", "tau", "len", "band", "cells"]]

    each = wanted.withColumn("len", F.size("v")).join(bands, "len").select("qkey", "v", "len", "band")
    home = each.mapInPandas(asks, "qkey long, v array<double>, len int, band int, cell int")
    # A query's own cell may have no vectors: then nothing is found there.
    first = materialize(found(home.withColumn("tau", F.lit(None).cast("double"))), "home")
    per_query = Window.partitionBy("qkey").orderBy(F.desc("score"), "key")
    best = lambda df: df.withColumn("rn", F.row_number().over(per_query)).filter(F.col("rn") <= k + 1)
    reach = best(first).groupBy("qkey").agg(F.max(F.when(F.col("rn") == k + 1, F.col("score"))).alias("tau"))
    second = home.join(reach, "qkey", "left").select("qkey", "v", "tau", *place)
    second = second.mapInPandas(further, "qkey long, v array<double>, tau double, len int, band int, cells array<int>")
    second = second.withColumn("cell", F.explode("cells")).drop("cells")
    ranked = materialize(best(first.unionByName(found(second))), "ranked")

    # A vector may be near to most queries, or be most queries' own: no join gathers their rows.
    hits = join_hot(ranked, entries.select("key", "ids"), "key").select("qkey", "score", F.explode("ids").alias("vec_id"))
    hits = hits.withColumn("rn", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rn") <= k + 1)
    lists = hits.groupBy("qkey").agg(F.collect_list(F.struct("score", "vec_id")).alias("hits"))  # k + 1 at most
    named = wanted.groupBy(F.xxhash64("v").alias("digest")).agg(F.collect_list(F.struct("v", "qkey")).alias("of"))
    own = F.filter("of", lambda x: x["v"] == F.col("v"))[0]["qkey"]
    queries = materialize(join_hot(asked, named, "digest").select(F.col("id").alias("query_id"), own.alias("qkey")), "queries")
    pairs = join_hot(queries, lists, "qkey").select("query_id", F.inline("hits")).filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
