"""SQL that grows boosted trees by definition: the values that operators.trees has to give, for a few rounds over small tables."""

from __future__ import annotations


def boosted(features: dict[str, str], rows: str, *, rounds: int, depth: int, step: float, l2: float, least_weight: float = 0.0, bins: int, symmetric: bool = False) -> list[tuple[str, str]]:
    """Common tables after ``rows`` (match_id, label, is_test and what ``features``, expressions by name, need); the last, m{rounds}, has id, k and margin m.

    Features have no nulls. Every step is a table of its own: cuts at quantiles, bins, and for each round probabilities, derivatives and a tree a class, a level
    at a time, with nodes numbered 1, then 2n and 2n + 1.
    """
    each = " UNION ALL ".join(f"SELECT match_id AS id, label, is_test, {i} AS f, CAST({e} AS DOUBLE) AS v FROM {rows}" for i, e in enumerate(features.values()))
    out = [
        ("long", each),
        ("ranked", "SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS rn, count(*) OVER (PARTITION BY f) AS n FROM long WHERE NOT is_test"),
        ("cuts", f"""SELECT f, v AS cut, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS c
          FROM (SELECT DISTINCT f, v FROM ranked JOIN generate_series(1, {bins - 1}) s(i) ON rn = greatest(1, ceil(i * n / {bins}.0::DOUBLE)))"""),
        ("binned", "SELECT l.id, l.f, l.is_test, count(c.c) AS bin FROM long l LEFT JOIN cuts c ON l.f = c.f AND c.cut < l.v GROUP BY ALL"),
        ("m0", f"SELECT match_id AS id, label, is_test, k, 0.0::DOUBLE AS m FROM {rows}, (VALUES (0), (1), (2)) t(k)"),
    ]
    worth = f"gl * gl / (hl + {l2}) + (g - gl) * (g - gl) / (h - hl + {l2}) - g * g / (h + {l2})"
    for r in range(rounds):
        out.append((f"p{r}", f"SELECT *, exp(m) / sum(exp(m)) OVER (PARTITION BY id) AS p FROM m{r}"))
        out.append((f"s{r}_0", f"SELECT *, p - CASE WHEN label = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS g, greatest(2 * p * (1 - p), 1e-16::DOUBLE) AS h, 1 AS node FROM p{r}"))
        for d in range(depth):
            now, at = f"s{r}_{d}", f"{r}_{d}"
            out.append((f"h{at}", f"SELECT k, node, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {now} JOIN binned b USING (id) WHERE NOT b.is_test GROUP BY ALL"))
            out.append((f"c{at}", f"""SELECT k, node, x.f, c, sum(CASE WHEN bin <= c THEN g ELSE 0.0::DOUBLE END) AS gl, sum(CASE WHEN bin <= c THEN h ELSE 0.0::DOUBLE END) AS hl,
              sum(CASE WHEN bin <= c THEN n ELSE 0 END) AS nl, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM h{at} x JOIN cuts y ON x.f = y.f GROUP BY ALL"""))  # fmt: skip
            if symmetric:
                gain, where, key = f"SELECT k, f, c, round(sum({worth}), 7) AS gain FROM c{at} GROUP BY ALL", "true", "k"
            else:
                gain, where, key = f"SELECT *, round({worth}, 7) AS gain FROM c{at}", f"nl > 0 AND nl < n AND hl >= {least_weight} AND h - hl >= {least_weight}", "k, node"
            out.append((f"b{at}", f"SELECT {key}, f, c FROM ({gain}) WHERE gain > 1e-6 AND {where} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, f, c) = 1"))
            child = "CASE WHEN b.k IS NULL THEN s.node WHEN x.bin <= b.c THEN 2 * s.node ELSE 2 * s.node + 1 END"
            on = "s.k = b.k" + ("" if symmetric else " AND s.node = b.node")
            out.append((f"s{r}_{d + 1}", f"SELECT s.* REPLACE ({child} AS node) FROM {now} s LEFT JOIN b{at} b ON {on} LEFT JOIN binned x ON x.id = s.id AND x.f = b.f"))
        last = f"s{r}_{depth}"
        out.append((f"v{r}", f"SELECT k, node, -{step} * sum(g) / (sum(h) + {l2}) AS v FROM {last} WHERE NOT is_test GROUP BY ALL"))
        out.append((f"m{r + 1}", f"SELECT s.id, s.label, s.is_test, s.k, s.m + coalesce(v.v, 0.0::DOUBLE) AS m FROM {last} s LEFT JOIN v{r} v USING (k, node)"))
    return out


def predictions(last: str) -> str:
    """match_id, label, p_0, p_1, p_2 and prediction of the test rows from margins."""
    return f"""
SELECT id AS match_id, label, round(p_0, 6) AS p_0, round(p_1, 6) AS p_1, round(p_2, 6) AS p_2, CAST(CASE WHEN p_2 >= p_1 AND p_2 >= p_0 THEN 2 WHEN p_1 >= p_0 THEN 1 ELSE 0 END AS INTEGER) AS prediction
FROM (SELECT id, label, max(p) FILTER (WHERE k = 0) AS p_0, max(p) FILTER (WHERE k = 1) AS p_1, max(p) FILTER (WHERE k = 2) AS p_2
  FROM (SELECT *, exp(m) / sum(exp(m)) OVER (PARTITION BY id) AS p FROM {last} WHERE is_test) GROUP BY ALL)"""


def ordered_statistics(columns: dict[str, str], rows: str, label: str, classes: int, seed: int = 42) -> str:
    """Columns {name}_of_{k}: shares of the labels of earlier rows of the category, in the order of md5(id|seed), with a prior of weight one."""
    out = []
    for name, e in columns.items():
        over = f"OVER (PARTITION BY {e} ORDER BY md5(CAST(match_id AS VARCHAR) || '|{seed}'), match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        out += [f"(coalesce(sum(CASE WHEN {label} = {k} THEN 1 ELSE 0 END) {over}, 0) + 1.0::DOUBLE / {classes}) / (count(*) {over} + 1) AS {name}_of_{k}" for k in range(classes)]
    return f"SELECT *, {', '.join(out)} FROM {rows}"
