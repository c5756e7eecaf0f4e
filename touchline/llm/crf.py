"""Toxicity by a linear-chain conditional random field over tokens.

Token labels are weak: a token of a document labelled toxic is toxic if its word or a prefix of it occurs nearly only in such
documents. The field has two states, emission weights for words and their prefixes, and transition weights; it is fitted by
gradient ascent on the labelled sample. Marginals come from forward-backward; their sum and maximum give the document's score
by a logistic regression, and tokens whose marginal reaches one half give the offending offsets.

The recursion is exact but not token by token: a batch of texts is one sequence (a document's first token forgets what was
before), cut into as many stretches as each is long, and the 2 x 2 products of all stretches advance together. Longer sequences than PART
tokens go part by part, with the state of the parts before and after carried in.

Features are counted by their hashes, in tables of a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import labelled
from touchline.llm.common import slices, text_bytes, words

EDGES = b".,;:!?\"'()[]*%$&#|-_<>"
PREFIXES = range(3, 8)
THRESHOLD = 0.3
#: Likelihood ratios that a toxic feature may have to reach; which, is chosen by cross-validation within the sample.
RATIOS = (30.0, 22.0, 16.0, 12.0, 9.0)
#: No transition becomes rarer, though the sample may lack it.
LEAST_CHANCE = 0.01
#: Hashed features are numbers below this; a power of two.
HASHED = 1 << 22
#: Tokens whose products are held at one time.
PART = 1 << 17
CACHE = 200_000
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def features(word: bytes) -> list[int]:
    """Hashes of the word and its prefixes, all without punctuation at the ends."""
    w = word.strip(EDGES)
    return [zlib.crc32(f) % HASHED for f in (b"=" + w, *(b"^" + w[:k] for k in PREFIXES if len(w) > k))]


def _products(m: np.ndarray) -> np.ndarray:
    """Running products m[0], m[0] m[1], ... along the first axis of (steps, stretches, 2, 2), each scaled to sum 1."""
    out = np.empty_like(m)
    out[0] = m[0] / m[0].sum(axis=(1, 2), keepdims=True)
    for i in range(1, len(m)):
        p, q = out[i - 1], m[i]
        r = p[:, :, :1] * q[:, :1, :] + p[:, :, 1:] * q[:, 1:, :]
        out[i] = r / r.sum(axis=(1, 2), keepdims=True)
    return out


def _factors(logits: np.ndarray, starts: np.ndarray, transition: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """The 2 x 2 factor of each token: from the state before to its own; a first token forgets the state before."""
    m = np.empty((len(logits), 2, 2))
    # Emission factors of at most 1, so that nothing overflows.
    e1, e0 = np.exp(np.minimum(logits, 0.0)), np.exp(-np.maximum(logits, 0.0))
    m[:, :, 0], m[:, :, 1] = transition[None, :, 0] * e0[:, None], transition[None, :, 1] * e1[:, None]
    m[starts] = (initial[None, :] * np.stack([e0, e1], 1)[starts])[:, None, :]
    return m


def _product(m: np.ndarray) -> np.ndarray:
    """The product of all factors, scaled."""
    while len(m) > 1:
        even = len(m) // 2 * 2
        r = m[0:even:2] @ m[1:even:2]
        m = np.concatenate([r / r.sum(axis=(1, 2), keepdims=True), m[even:]])
    return m[0]


def marginals(logits: np.ndarray, starts: np.ndarray, transition: np.ndarray, initial: np.ndarray, part: int = PART) -> np.ndarray:
    """Marginals of state 1, as forward_backward gives them, holding the products of ``part`` tokens at a time."""
    cuts = [slice(i, min(i + part, len(logits))) for i in range(0, len(logits), part)]
    if len(cuts) < 2:
        return forward_backward(logits, starts, transition, initial)
    whole = [_product(_factors(logits[c], starts[c], transition, initial)) for c in cuts]
    unit = lambda x: x / x.sum()
    ahead, behind = [np.array([0.5, 0.5])], [np.array([0.5, 0.5])]
    for m in whole[:-1]:
        ahead.append(unit(ahead[-1] @ m))
    for m in whole[:0:-1]:
        behind.append(unit(m @ behind[-1]))
    return np.concatenate([forward_backward(logits[c], starts[c], transition, initial, before=a, after=b) for c, a, b in zip(cuts, ahead, behind[::-1], strict=True)])


def forward_backward(
    logits: np.ndarray, starts: np.ndarray, transition: np.ndarray, initial: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None
):
    """Marginals of state 1 for tokens with these emission logits; with pairs also the expected transition and start counts.

    before, after: weights of the states ahead of the first token and behind the last.
    """
    n = len(logits)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    even = np.array([0.5, 0.5])
    side = int(np.ceil(np.sqrt(n)))
    size = side * int(np.ceil(n / side))
    m = np.empty((size, 2, 2))
    m[:n] = _factors(logits, starts, transition, initial)
    m[n:] = np.eye(2)  # the padding changes nothing
    own = m.reshape(-1, side, 2, 2).swapaxes(0, 1)  # stretches follow each other along the second axis
    # own[i, j]: token j * side + i.
    ahead = _products(own)
    alpha = np.empty((own.shape[1], 2))
    now = even if before is None else before
    for j in range(own.shape[1]):
        alpha[j] = now
        now = now @ ahead[-1, j]
        now = now / now.sum()
    a = alpha[None, :, :1] * ahead[:, :, 0, :] + alpha[None, :, 1:] * ahead[:, :, 1, :]
    behind = _products(own[::-1].swapaxes(2, 3))  # transposed: products from the right
    beta = np.empty((own.shape[1], 2))
    now = even if after is None else after
    for j in range(own.shape[1] - 1, -1, -1):
        beta[j] = now
        now = now @ behind[-1, j]
        now = now / now.sum()
    b = np.empty_like(a)
    b[-1] = beta
    rest = behind[:-1]
    b[:-1] = (beta[None, :, :1] * rest[:, :, 0, :] + beta[None, :, 1:] * rest[:, :, 1, :])[::-1]
    a, b = a.swapaxes(0, 1).reshape(-1, 2)[:n], b.swapaxes(0, 1).reshape(-1, 2)[:n]
    g = a * b
    p = g[:, 1] / g.sum(1)
    if not pairs:
        return p
    inner = np.flatnonzero(~starts)
    x = a[inner - 1][:, :, None] * m[inner] * b[inner][:, None, :]
    x /= x.sum(axis=(1, 2), keepdims=True)
    first = p[starts].sum()
    return p, x.sum(0), np.array([starts.sum() - first, first])


@dataclass
class Model:
    weights: dict[int, float]  # of hashed features
    bias: float
    transition: np.ndarray
    initial: np.ndarray
    document: np.ndarray  # logistic weights: see _document

    def emission(self, word: bytes) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


class _Cache(dict):
    def __init__(self, f):
        self.f = f

    def __missing__(self, key):
        if len(self) > CACHE:
            self.clear()
        out = self[key] = self.f(key)
        return out


def _document(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1, the largest marginal, log(1 + sum) and the log of 1 + the sum for a hundred tokens, of each document that has tokens."""
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros((0, 4))
    total = np.add.reduceat(p, at)
    return np.stack([np.ones(len(at)), np.maximum.reduceat(p, at), np.log1p(total), np.log1p(100 * total / np.diff(np.append(at, len(p))))], 1)


class _Words(_Cache):
    """word -> its hashed features, as an array."""

    def __init__(self):
        super().__init__(lambda w: np.array(features(w), dtype=np.int32))


def toxic_features(own: list[np.ndarray], y: np.ndarray, ratio: float) -> np.ndarray:
    """For each hashed feature, whether it occurs nearly only in toxic documents, and too often for chance.

    own: the distinct hashed features of each document. A likelihood ratio of ``ratio`` and a twentyfold rate are asked for.
    """
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    d1, d0 = np.zeros(HASHED, dtype=np.int32), np.zeros(HASHED, dtype=np.int32)
    for x, label in zip(own, y.tolist(), strict=True):
        (d1 if label else d0)[x] += 1
    at = np.flatnonzero(d1)
    a, b = d1[at].astype(float), d0[at].astype(float)
    both = (a + b) / (n1 + n0)
    score = 2 * (a * np.log(a / (n1 * both)) + np.where(b > 0, b * np.log(np.maximum(b, 1) / (n0 * both)), 0.0))
    out = np.zeros(HASHED, dtype=bool)
    out[at[(a / n1 >= 20 * (b + 0.1) / n0) & (score >= ratio)]] = True
    return out


def choose_ratio(own: list[np.ndarray], y: np.ndarray) -> float:
    """Of RATIOS, that by which features of one half of the sample tell the toxic documents of the other half best (F1); the larger of equal ones."""
    half = np.arange(len(y)) % 2
    scores = []
    for ratio in RATIOS:
        right = wrong = missed = 0
        for h in (0, 1):
            known = toxic_features([x for x, k in zip(own, half, strict=True) if k == h], y[half == h], ratio)
            hit = np.array([bool(known[x].any()) for x, k in zip(own, half, strict=True) if k != h], dtype=bool)
            truth = y[half != h] == 1
            right, wrong, missed = right + (hit & truth).sum(), wrong + (hit & ~truth).sum(), missed + (~hit & truth).sum()
        scores.append(2 * right / max(1, 2 * right + wrong + missed))
    return RATIOS[int(np.argmax(scores))]


def fit(rows: list[tuple[bytes, int]], steps: int = 25, field_rows: int = 1000) -> Model:
    """A model from (text, label) rows; without any toxic row it scores everything near 0. The field sees at most ``field_rows``, half of them of each label."""
    y_doc = np.array([y for _, y in rows], dtype=np.int64)
    known = _Words()
    distinct = lambda text: set().union(*map(set, words(text)))
    empty = np.zeros(0, dtype=np.int32)
    own = [np.unique(np.concatenate([empty, *map(known.__getitem__, distinct(t))])) for t, _ in rows]
    toxic = toxic_features(own, y_doc, choose_ratio(own, y_doc))
    toxic[[zlib.crc32(f) % HASHED for f in (b"=",)]] = False
    del own
    # The field itself is fitted on fewer documents: their tokens are many.
    order = [*np.flatnonzero(y_doc == 1)[: field_rows // 2].tolist(), *np.flatnonzero(y_doc == 0)[: field_rows // 2].tolist()]
    types: dict[bytes, int] = {}
    tok, starts, y_tok = [], [], []
    for i in order:
        ids = [np.fromiter((types.setdefault(x, len(types)) for x in part), dtype=np.int32, count=len(part)) for part in words(rows[i][0])]
        ids = np.concatenate(ids)
        tok.append(ids)
        starts.append(np.arange(len(ids)) == 0)
        y_tok.append(np.full(len(ids), rows[i][1], dtype=bool))
    tok, starts, y_tok = (np.concatenate([np.zeros(0, dtype=d), *x]) for x, d in ((tok, np.int32), (starts, bool), (y_tok, bool)))
    lists = [known[x] for x in types]
    is_toxic = np.array([toxic[x].any() for x in lists] or [False])
    truth = y_tok & is_toxic[tok] if len(tok) else np.zeros(0, dtype=bool)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists]) if lists else np.zeros(0, dtype=np.int64)
    names, feats = np.unique(np.concatenate([empty, *lists]), return_inverse=True)

    theta, bias = np.zeros(len(names)), -5.0
    trans, init = np.log(np.array([[0.98, 0.02], [0.9, 0.1]])), np.log(np.array([0.98, 0.02]))
    inner = np.flatnonzero(~starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[inner - 1].astype(int), truth[inner].astype(int)), 1)
    seen_first = np.bincount(truth[starts].astype(int), minlength=2).astype(float)
    soft = lambda z: np.exp(z) / np.exp(z).sum(axis=-1, keepdims=True)
    # Parts of whole documents, so that products of few tokens are held.
    cuts = np.flatnonzero(starts)
    cuts = [int(c) for c, last in zip(cuts, [-PART, *cuts], strict=False) if c // PART != last // PART]
    cuts = list(zip(cuts, [*cuts[1:], len(tok)], strict=False))
    m, v = np.zeros(len(theta) + 1), np.zeros(len(theta) + 1)
    for step in range(1, steps + 1 if len(tok) else 1):
        e_type = bias + np.bincount(owner, weights=theta[feats], minlength=len(lists))
        p, xi, first = np.empty(len(tok)), np.zeros((2, 2)), np.zeros(2)
        for a, b in cuts:
            p[a:b], x, f = forward_backward(e_type[tok[a:b]], starts[a:b], soft(trans), soft(init), pairs=True)
            xi, first = xi + x, first + f
        g_type = np.bincount(tok, weights=truth - p, minlength=len(lists))
        g = np.append(np.bincount(feats, weights=g_type[owner], minlength=len(theta)) - 0.01 * theta, (truth - p).sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.4 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta, bias = theta + move[:-1], bias + 0.25 * move[-1]
        # Transition weights: a gradient step per expected visit.
        trans = np.log(np.maximum(soft(trans + 0.3 * (seen - xi) / (xi.sum(1, keepdims=True) + 5)), LEAST_CHANCE))
        init = np.log(np.maximum(soft(init + 0.3 * (seen_first - first) / (first.sum() + 5)), LEAST_CHANCE))
    kept = {int(f): float(w) for f, w in zip(names, theta, strict=True) if abs(w) > 0.05}
    model = Model(kept, float(bias), soft(trans), soft(init), np.array([-4.0, 6.0, 1.0, 0.0]))
    if len(tok):
        cache, x, y = _Cache(model.emission), [], []
        for t, label in rows:
            logits, begins = _logits([t], cache)
            if len(logits):
                x.append(_document(marginals(logits, begins, model.transition, model.initial), begins))
                y.append(label)
        model.document = _logistic(np.concatenate(x), np.array(y))
    return model


def _logits(texts: list[bytes], cache: _Cache) -> tuple[np.ndarray, np.ndarray]:
    """Emission logits of all tokens, and where texts start."""
    each = [np.concatenate([np.fromiter(map(cache.__getitem__, part), dtype=float, count=len(part)) for part in words(t)]) for t in texts]
    starts = np.zeros(sum(map(len, each)), dtype=bool)
    at = 0
    for x in each:
        if len(x):
            starts[at] = True
        at += len(x)
    return np.concatenate(each) if each else np.zeros(0), starts


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _offsets(text: bytes, hits: list[int]) -> list[dict[str, int]]:
    """Start and stop of the tokens of these numbers."""
    out, wanted = [], iter(hits)
    now = next(wanted, None)
    if now is not None:
        for i, m in enumerate(TOKEN.finditer(text)):
            if i == now:
                out.append({"start": m.start(), "stop": m.end()})
                now = next(wanted, None)
                if now is None:
                    break
    return out


def tag(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, spans (array of start, stop: UTF-8 byte offsets of tokens with a marginal of one half).

    Null and empty texts have no spans and the score of a document without toxic tokens; repeated rows stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cache = _Cache(own.emission)
        empty = 1 / (1 + np.exp(-np.clip(np.array([1.0, 0.0, 0.0, 0.0]) @ own.document, -30, 30)))
        for batch in batches:
            scores, spans = [], []
            for part in slices(batch.column(2)):
                logits, starts = _logits(part, cache)
                p = marginals(logits, starts, own.transition, own.initial)
                at = np.flatnonzero(starts).tolist()
                bounds = iter(zip(at, [*at[1:], len(p)], strict=True))
                full = np.array([bool(t) and not t.isspace() for t in part], dtype=bool)
                s = np.full(len(part), empty)
                s[full] = 1 / (1 + np.exp(-np.clip(_document(p, starts) @ own.document, -30, 30)))
                scores.append(s)
                for text, tokens in zip(part, full, strict=True):
                    a, b = next(bounds) if tokens else (0, 0)
                    spans.append(_offsets(text, np.flatnonzero(p[a:b] >= 0.5).tolist()))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, span)], names=["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), labelled.held_out(id_col).alias("held_out"), text_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,stop:int>>")


def score_toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 4000, field_rows: int = 1000, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold (a quarter of them toxic, where there are so many), then ``tag`` every
    document. Toxic features and the documents' logistic weights come from all of the sample, the field's weights from ``field_rows`` of it."""
    return tag(docs, fit(labelled.sample(docs, labels, "toxic", rows=sample_rows, share=0.25), field_rows=field_rows), threshold=threshold)
