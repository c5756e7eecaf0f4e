"""Secret scans: patterns find candidates, corpus-wide ownership frequency separates examples from live-looking credentials.

Base kinds (assign, access, hex) always count. Further kinds are broad patterns that also hit harmless text: their spans count only if the
corpus shows the value with few distinct owners and repositories. A value that many owners have is a copied example.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from touchline.llm.common import join_hot, materialize, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Any match of ACCESS, HEX or ENTROPY that counts lies within one of these runs.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PREFIXED = re.compile(r"(?:gh[pousr]_|sk_live_|glpat-|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}")
ENTROPY = re.compile(r"[A-Za-z0-9+/_=-]{32,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
PEM_END = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
#: Where no END line follows: header fields, then runs of base64 between white space, escaped line ends, quotes and the like, and a short last line.
PEM_BODY = re.compile(r"""(?:(?:\\[nrt]|[\s"'+,>#*;])*(?:[A-Z][A-Za-z-]{1,40}+:\x20[^\n\\]*(?=\n|\\n)|[A-Za-z0-9+/]{16,}={0,2}))*(?:(?:\\[nrt]|[\s"'+,>#*;])*[A-Za-z0-9+/]{2,15}={1,2}|(?<=[A-Za-z0-9+/])(?:\r?\n|\\n)[A-Za-z0-9+/]{2,15}(?![^\s"'\\]))?""")
PEM_FIELD = re.compile(r"[A-Z][A-Za-z-]{1,40}+:\x20[^\n\\]*|\\[nrt]|[^A-Za-z0-9+/=]")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
KINDS = ("assign", "access", "hex", "prefixed", "jwt", "pem", "entropy")
BASE = 3
#: The shortest match of each base kind; of assign, its second group.
LEAST = (6, 20, 24)
#: A value in texts of more owners or repositories than these is a copied example.
MOST_OWNERS = 2
MOST_REPOSITORIES = 2
MIN_ENTROPY = 3.5
#: Most example hashes that are broadcast to redact; beyond it the spans are joined.
BROADCAST_EXAMPLES = 1_000_000

SPAN = "struct<kind:int,start:int,stop:int,value:bigint>"


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def pem_keys(text: str) -> list[tuple[int, int, int, str]]:
    """(5, start, stop, body) of private keys, from the header through the END line, or to the end of the base64 body where there is none.

    The body is without line ends and header fields, so a key is one value however it is wrapped; a header without a body is its own value.
    """
    out, heads = [], list(PEM.finditer(text))
    if not heads:
        return out
    for m, until in zip(heads, [*(h.start() for h in heads[1:]), len(text)], strict=True):
        end = PEM_END.search(text, m.end(), until)
        if end and "-----" in text[m.end() : end.start()]:  # another block begins or ends before: that END is not this key's
            end = None
        body_stop = end.start() if end else PEM_BODY.match(text, m.end(), until).end()
        body = PEM_FIELD.sub("", text[m.end() : body_stop])
        out.append((5, m.start(), end.end() if end else body_stop, body or m[0]))
    return out


def jwts(text: str) -> list[tuple[int, int, int, str]]:
    """(4, start, stop, value) of JWTs. Where the first start within a run of their characters fails, so do the later ones: each run is tried once."""
    out, at = [], text.find("eyJ")
    while at >= 0:
        m = JWT.match(text, at)
        if m:
            out.append((4, at, m.end(), m[0]))
        at = text.find("eyJ", m.end() if m else JWT_RUN.match(text, at).end())
    return out


class Taken:
    """Whether a stretch overlaps none of some spans: they are merged and sorted, so each question is one bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.stops = [], []
        for a, b in sorted(spans):
            if self.stops and a <= self.stops[-1]:
                self.stops[-1] = max(b, self.stops[-1])
            else:
                self.starts.append(a)
                self.stops.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.stops, a)
        return i == len(self.stops) or self.starts[i] >= b


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, stop, hash of the value), by start and kind. Offsets are code points; matches of a kind don't overlap.

    Base matches come from the stated patterns over the whole text, leftmost first; too short ones are dropped after matching, as they use up
    their characters. Further kinds leave out what lies within a base match, but for private keys, which are spanned whole.
    """
    found: list[tuple[int, int, int, str]] = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST[0]]
    runs = [m.span() for m in RUN.finditer(text)]
    for a, b in runs:
        if "AKIA" in text[a:b]:
            found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= LEAST[1]]
        if b - a >= LEAST[2]:
            found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= LEAST[2]]
    # A whole key is more than any base match in it or over its header, and covers what else lies within.
    keys = pem_keys(text) if "PRIVATE KEY" in text else []
    taken = [(a, b) for _, a, b, _ in found + keys]
    free = Taken(taken).free
    more = jwts(text)
    for a, b in runs:
        more += [(3, m.start(), m.end(), m[0]) for m in PREFIXED.finditer(text, a, b)]
    more = keys + [x for x in more if free(x[1], x[2])]
    free = Taken(taken + [(a, b) for _, a, b, _ in more]).free
    for a, b in runs:
        if b - a >= 32:
            for m in ENTROPY.finditer(text, a, b):
                v = m[0]
                mixed = any("a" <= c <= "z" for c in v) and any("A" <= c <= "Z" for c in v) and any("0" <= c <= "9" for c in v)
                if mixed and free(m.start(), m.end()) and entropy(v) >= MIN_ENTROPY:
                    more.append((6, m.start(), m.end(), v))
    hashed = [(k, a, b, xxhash.xxh64_intdigest(v.encode()) - (1 << 63)) for k, a, b, v in found + more]
    return sorted(hashed, key=lambda x: (x[1], x[0]))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in spans)


def _scanned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.int64())]))
    for array in texts:
        spans, shas = [], []
        for part in slices(array):
            for text in part:
                got = candidates(text or "")
                spans.append([dict(zip(("kind", "start", "stop", "value"), x, strict=True)) for x in got])
                shas.append(hashlib.sha256(spans_text([x for x in got if x[0] < BASE]).encode()).hexdigest())
        yield pa.StructArray.from_arrays([pa.array(spans, kind), pa.array(shas, pa.string())], names=["spans", "base_sha256"])


def _scan(text: Column | str) -> Column:
    """spans (all candidates) and base_sha256 of a text column."""
    return arrow_udf(_scanned, f"struct<spans:array<{SPAN}>,base_sha256:string>")(text)


def ownership(spans: DataFrame) -> DataFrame:
    """value, owners, repositories: in how many distinct owners' and repositories' texts each value occurs.

    Triples are made distinct first, with partial aggregation, so a value that a third of the texts hold is no large group.
    """
    triples = spans.select("value", "owner", "repository").distinct()
    owners = triples.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def is_example() -> Column:
    return (F.col("owners") > MOST_OWNERS) | (F.col("repositories") > MOST_REPOSITORIES)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """doc_id, spans (array of kind, start, stop, value, owners, repositories, live), base_sha256 of every row.

    owner and repository default to the source, and the source with the language. All base spans are there; further kinds only if live.
    A null or empty text has no spans; null owners count as one owner; repeated rows stay; an empty table gives no rows.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))
    rows = rows.withColumn("s", _scan("text")).select("doc_id", "owner", "repository", "s.spans", "s.base_sha256")
    # Numbers of rows hold from here on: they are written down.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scanned")
    each = rows.filter(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("s")).select("row", "owner", "repository", "s.*")
    known = ownership(each)
    judged = join_hot(each, known, "value").withColumn("live", ~is_example())
    judged = judged.filter((F.col("kind") < BASE) | F.col("live"))
    span = F.struct("start", "kind", "stop", "value", "owners", "repositories", "live")
    judged = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("found"))  # of one document
    out = rows.select("row", "doc_id", "base_sha256").join(judged, "row", "left")
    return out.select("doc_id", F.coalesce("found", F.array().cast(judged.schema["found"].dataType)).alias("spans"), "base_sha256")


def _redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, *, text_col: str = "text", owner_col: str = "source", lang_col: str = "lang", most: int = BROADCAST_EXAMPLES) -> DataFrame:
    """docs with base spans and live further spans replaced in the text; all rows and columns stay, null texts stay null.

    Only hashes of copied examples of further kinds reach the texts: broadcast up to ``most`` of them, joined by text digest beyond.
    """
    keyed = docs.select(F.col(text_col).alias("text"), F.col(owner_col).cast("string").alias("owner"), F.concat_ws("/", F.col(owner_col), F.col(lang_col)).alias("repository"))
    further = keyed.withColumn("s", F.explode(_scan(F.coalesce("text", F.lit("")))["spans"])).select("owner", "repository", "s.kind", "s.value").filter(f"kind >= {BASE}")
    examples = materialize(ownership(further).filter(is_example()).select("value"), "examples")
    text = F.coalesce(F.col(text_col), F.lit(""))
    if examples.count() <= most:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in examples.collect()))

        @arrow_udf("string")
        def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            drop = known.value
            for array in texts:
                out = []
                for part in slices(array):
                    for t in part:
                        out.append(_redact(t, [x[:3] for x in candidates(t) if x[0] < BASE or x[3] not in drop]))
                yield pa.array(out, pa.string())

        return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), clean(text)))

    @arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_redact(t, [(s["kind"], s["start"], s["stop"]) for s in own or []]) for t, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    # Spans depend on the text alone: one row for each text that has any, then back by its digest.
    distinct = docs.filter(F.col(text_col).isNotNull()).select(F.sha2(F.col(text_col).cast("binary"), 256).alias("d"), F.explode(_scan(text)["spans"]).alias("s")).select("d", "s.*").distinct()
    kept = distinct.join(examples.withColumn("example", F.lit(True)), "value", "left").filter(f"kind < {BASE} or example is null")
    kept = kept.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("__spans")).withColumnRenamed("d", "__digest")
    out = docs.join(kept, F.sha2(F.col(text_col).cast("binary"), 256) == F.col("__digest"), "left")
    out = out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), cut(text, F.col("__spans"))))
    return out.select(*docs.columns)
