"""Byte-level BPE as a lazily determinised finite-state transducer, and decoding with an incremental UTF-8 state machine.

A prefix of a piece has exactly one BPE encoding, and a sequence of tokens is an encoding if and only if each adjacent pair of
tokens is the encoding of its own bytes. So the last token of each prefix's encoding follows from those before, one byte at a
time. A state of the transducer holds the positions at which a later token can still begin: for each, the trie node of the
bytes since, and the last token before it. A move reads a byte and writes the last token of the prefix that ends there, which is that
before the newest position, so the state alone tells it. Which tokens are certain follows from these, looking ahead no further than the longest token: the way back from every position that
is still open is the same up to there. States and moves are made when first needed, and all are forgotten when there are too many.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from touchline.llm.common import slices

#: Of adjacent tokens, five times as many are remembered. A worker meets some 200,000 states in tens of thousands of texts: to forget them is to make most anew.
MOST_STATES = 200_000
#: Of each of two generations: what is asked for again moves to the younger one, the older one goes.
MOST_PIECES = 300_000
#: Bytes of a piece after which certain tokens are emitted.
STRETCH = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens' bytes and ranks from a file of base64 and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_pairs(ranks: dict[bytes, int], piece: bytes, least: int = 1) -> list[int]:
    """Plain BPE by definition: merge the adjacent pair of lowest rank, leftmost first, down to ``least`` tokens. For short pieces and tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    def __init__(self, ranks: dict[bytes, int], states: int | None = None):
        self.ranks, self.most = ranks, states or MOST_STATES
        self.tokens: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}
        self.length = {r: len(t) for t, r in ranks.items()}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [False]
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            node = 0
            for c in token:
                key = node << 8 | c
                if key not in self.child:
                    self.inner[node] = True
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[key]
            self.ends[node] = rank
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone."""
        # Of each state its open positions (trie node << 24 | last token before it + 1), and the last token of the prefix that ends there.
        self.states: list[tuple[int, ...]] = [(0,)]
        self.last = [-1]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, int] = {}

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; of a single byte, it twice."""
        got = self.halves.get(token)
        if got is None:
            own = self.tokens[token]
            a, b = byte_pairs(self.ranks, own, 2) if len(own) > 1 else (token, token)
            got = self.halves[token] = a, b
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a (-1: begin a piece): no merge across the cut comes before those that make both.

        The merges next to the cut are undone, the latest first. A pair across it that merges earlier than what was undone last, or as early and
        further left, would have been merged.
        """
        if len(self.pairs) > 5 * self.most:
            self.pairs.clear()
        key = (a + 1) << 24 | b
        if a < 0:
            got = self.pairs[key] = byte_pairs(self.ranks, self.tokens[b]) == [b]
            return got
        tokens, ranks, split, limit, got = self.tokens, self.ranks, self.split, 1 << 60, True
        while True:
            merged = ranks.get(tokens[a] + tokens[b])
            if merged is not None and merged < limit:
                got = False
                break
            left, right = len(tokens[a]) > 1, len(tokens[b]) > 1
            if left and (a > b or not right):
                limit, a = a, split(a)[1]
            elif right:
                limit, b = b + 1, split(b)[0]
            else:
                break
        self.pairs[key] = got
        return got

    def move(self, state: int, c: int) -> int:
        """The next state."""
        child, ends, inner, pairs = self.child, self.ends, self.inner, self.pairs
        ahead, token = [], -1
        for position in self.states[state]:
            to = child.get(position >> 24 << 8 | c)
            if to is None:
                continue
            before = position & 0xFFFFFF
            if token < 0 and (t := ends[to]) >= 0:
                ok = pairs.get(before << 24 | t)
                if self.fits(before - 1, t) if ok is None else ok:
                    token = t
            if inner[to]:
                ahead.append(to << 24 | before)
        if token < 0:
            raise ValueError("the vocabulary lacks a byte")
        ahead.append(token + 1)
        new = tuple(ahead)
        number = self.number.get(new)
        if number is None:
            number = self.add(new, token)
        self.moves[state << 8 | c] = number
        return number

    def add(self, positions: tuple[int, ...], token: int) -> int:
        number = self.number[positions] = len(self.states)
        self.states.append(positions)
        self.last.append(token)
        return number

    def back(self, written: list[int], stop: int) -> list[int]:
        """Tokens of the prefix that ends at stop, from the last tokens of all its prefixes."""
        out, length = [], self.length
        while stop > 0:
            token = written[stop - 1]
            out.append(token)
            stop -= length[token]
        out.reverse()
        return out

    def stream(self, piece: bytes) -> Iterator[list[int]]:
        """Token ids of one piece in lists: what is certain after each stretch, the rest at its end. Memory doesn't grow with the piece."""
        if len(self.states) > self.most:
            self.forget()
        state, moves, written = 0, self.moves, []
        for i, c in enumerate(piece, 1):
            state = moves.get(state << 8 | c) or self.move(state, c)
            written.append(self.last[state])
            if not i % STRETCH:
                # A later token begins at an open position: at the depth of its trie node before here.
                ways = [self.back(written, len(written) - self.depth[position >> 24]) for position in self.states[state]]
                n = next((k for k, own in enumerate(zip(*ways, strict=False)) if len(set(own)) > 1), min(map(len, ways)))
                if sure := ways[0][:n]:
                    yield sure
                    del written[: sum(map(self.length.__getitem__, sure))]
                if len(self.states) > self.most:
                    now, token = self.states[state], self.last[state]
                    self.forget()
                    moves, state = self.moves, self.add(now, token)
        yield self.back(written, len(written))

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > STRETCH:
            return tuple(chain.from_iterable(self.stream(piece)))
        if len(self.states) > self.most:
            self.forget()
        state, known, move, passed = 0, self.moves.get, self.move, []
        for c in piece:
            state = known(state << 8 | c) or move(state, c)
            passed.append(state)
        out, at, last, length = [], len(passed), self.last, self.length
        while at > 0:
            token = last[passed[at - 1]]
            out.append(token)
            at -= length[token]
        out.reverse()
        return tuple(out)


class Utf8Machine:
    """Incremental UTF-8: states are the number of bytes that must follow, and the range of the next one.

    feed() gives the complete characters so far; an invalid or cut sequence becomes U+FFFD, one for each maximal part of a valid one.
    """

    def __init__(self):
        self.left, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def get(self) -> tuple[int, int, int, bytes]:
        return (self.left, self.low, self.high, bytes(self.held)) if self.left else (0, 0x80, 0xBF, b"")

    def set(self, state: tuple[int, int, int, bytes]) -> None:
        self.left, self.low, self.high, self.held = *state[:3], bytearray(state[3])

    def feed(self, data: bytes) -> str:
        if not self.left and data.isascii():
            return data.decode("ascii")
        out: list[str] = []
        for c in data:
            if self.left and not self.low <= c <= self.high:
                out.append("�")
                self.left, self.held = 0, bytearray()
            if self.left:
                self.held.append(c)
                self.left, self.low, self.high = self.left - 1, 0x80, 0xBF
                if not self.left:
                    out.append(self.held.decode())
                    self.held = bytearray()
            elif c < 0x80:
                out.append(chr(c))
            elif 0xC2 <= c <= 0xF4:
                self.left = 1 if c < 0xE0 else 2 if c < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(c, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(c, 0xBF)
                self.held = bytearray([c])
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        """What a sequence that is cut at the end gives."""
        cut, self.left, self.held = self.left, 0, bytearray()
        return "�" if cut else ""


def decode_stream(tokens: dict[int, bytes], ids: Iterable[int]) -> Iterator[str]:
    """Text of the ids, piece by piece, each as soon as its characters are complete."""
    machine = Utf8Machine()
    for i in ids:
        if text := machine.feed(tokens[i]):
            yield text
    if text := machine.close():
        yield text


def _class(name: str) -> list[tuple[int, int]]:
    """The code points of a Unicode property as ranges."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    # A run may pass over the surrogates, which no text has.
    return [(ord(m[0][0]), ord(m[0][-1])) for m in regex.finditer(rf"\p{{{name}}}+", every)]


#: Beyond the basic plane, where the standard library's engine tries each range of a class in turn: texts without these have classes without them.
FAR = re.compile("[\U00010000-\U0010ffff]")


@cache
def splitter(pattern: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """The pattern for ASCII texts, for those of the basic plane and for any, with the standard library's faster engine: \\p{L}, \\p{N} and \\s as explicit classes."""
    space = r"\t-\r \x85\xa0  -     　"
    letters, numbers = _class("L"), _class("N")

    def made(letters: str, numbers: str, white: str) -> re.Pattern:
        out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        return re.compile(out.replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]"))

    def ranges(every: list[tuple[int, int]], most: int) -> str:
        return "".join(f"\\U{a:08x}-\\U{min(b, most):08x}" for a, b in every if a <= most)

    return made("A-Za-z", "0-9", r"\t-\r "), *(made(ranges(letters, most), ranges(numbers, most), space) for most in (0xFFFF, 0x10FFFF))


class _Pieces(dict):
    """piece -> its ids, in two generations."""

    def __init__(self, transducer: Transducer, most: int | None = None):
        self.transducer, self.older, self.most = transducer, {}, most or MOST_PIECES

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > self.most:
            self.older.clear()
            self.older.update(self)
            self.clear()
        out = self.older.get(piece) or self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) < 64:
            self[piece] = out
        return out


class Codec:
    """``pieces`` and ``states`` bound what is remembered; results don't depend on them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int | None = None, states: int | None = None):
        self.transducer = Transducer(ranks, states)
        self.plain, self.near, self.any = splitter(pattern)
        self.pieces = _Pieces(self.transducer, pieces)
        self.tokens = self.transducer.tokens
        self.held: list[tuple[int, int, int, bytes]] = [Utf8Machine().get()]  # states of the machine
        self.steps: dict[int, tuple[int, str]] = {}
        #: Tokens that begin or end within a character.
        self.parts = {i for i, t in self.tokens.items() if t.decode("utf-8", "replace").encode() != t}

    def encode(self, text: str) -> list[int]:
        own = self.plain if text.isascii() else self.any if FAR.search(text) else self.near
        return list(chain.from_iterable(map(self.pieces.__getitem__, own.findall(text))))

    def decode(self, ids: list[int]) -> str:
        """The machine's moves by whole tokens, kept once made: its states are few, as are tokens that hold parts of characters."""
        if self.parts.isdisjoint(ids):
            return b"".join(map(self.tokens.__getitem__, ids)).decode()
        known, out, state = self.steps.get, [], 0
        for i in ids:
            state, text = known(state << 20 | i) or self.step(state, i)
            out.append(text)
        machine = Utf8Machine()
        machine.set(self.held[state])
        return "".join(out) + machine.close()

    def step(self, state: int, token: int) -> tuple[int, str]:
        """The machine's next state and the text that becomes complete."""
        machine = Utf8Machine()
        machine.set(self.held[state])
        text = machine.feed(self.tokens[token])
        now = machine.get()
        if now not in self.held:
            self.held.append(now)
        out = self.steps[state << 20 | token] = self.held.index(now), text
        return out


@cache
def codec(path: str, pattern: str) -> Codec:
    """One a process that has the file."""
    return Codec(load_ranks(path), pattern)


_own: dict[tuple, Codec] = {}


def shared_codec(spark: SparkSession, path: str, pattern: str, pieces: int | None = None, states: int | None = None) -> Callable[[], Codec]:
    """What gives a worker process its codec. Only the driver reads the file: its ranks are broadcast, as many as the vocabulary has."""
    ranks = spark.sparkContext.broadcast(load_ranks(path))

    def get() -> Codec:
        key = path, pattern, pieces, states
        if key not in _own:
            _own.clear()
            _own[key] = Codec(ranks.value, pattern, pieces, states)
        return _own[key]

    return get


def ids_of(own: Codec, texts: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """Ids of texts, few rows a batch: neither the worker nor the JVM holds those of a whole batch of texts."""
    for array in texts:
        for part in slices(array):
            yield pa.array([own.encode(t or "") for t in part], pa.list_(pa.int32()))


def encoded(spark: SparkSession, text: Column, path: str, pattern: str, *, pieces: int | None = None, states: int | None = None) -> Column:
    """array<int> of token ids; null and empty texts give an empty array."""
    get = shared_codec(spark, path, pattern, pieces, states)

    @arrow_udf("array<int>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return ids_of(get(), texts)

    return run(text)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", pieces: int = 60_000, states: int = 30_000) -> DataFrame:
    """docs without the text, with token_ids and n_tokens instead.

    All rows stay; null texts have no tokens. The caller's columns of these names become token_ids_given and n_tokens_given. Less is remembered
    than by round_trip (``pieces``, ``states``), as ids of whole batches are held as well.
    """
    kept = [F.col(c).alias(f"{c}_given" if c in ("token_ids", "n_tokens") else c) for c in docs.columns if c != text_col]
    ids = encoded(docs.sparkSession, F.coalesce(F.col(text_col), F.lit("")), path, pattern, pieces=pieces, states=states)
    return docs.select(*kept, ids.alias("token_ids")).withColumn("n_tokens", F.size("token_ids").cast("long"))


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, its ids decoded again.

    Null and empty texts have no ids; repeated rows stay; an empty table gives no rows.
    """

    get = shared_codec(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        names = [b"%d" % i for i in range(max(own.tokens) + 1)]
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for part in slices(batch.column(1)):
                for text in part:
                    ids = own.encode(text)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest())
                    decoded_sha.append(hashlib.sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
