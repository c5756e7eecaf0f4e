import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.llm import bpe, maxmatch

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("aeinrst' \n\t0123456789,.é日　 ", max_size=200))
def test_encodes_as_the_library_and_decodes_back(library, codec, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text


def test_long_runs_and_few_states(library, codec):
    r = random.Random(1)
    codec = bpe.Codec(codec.transducer.ranks, public_tokenizers.PATTERN, pieces=10, states=50)
    for alphabet in ("a", "ab", "abcdefghijklmnop", "éàü", "=-*", "0"):
        text = "".join(r.choice(alphabet) for _ in range(3000))
        assert codec.encode(text) == library.encode_ordinary(text)


def test_special_tokens_are_ordinary_text(library, codec):
    assert codec.encode("a<|endoftext|>b") == library.encode_ordinary("a<|endoftext|>b")


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_utf8_machine_equals_the_decoder_however_cut(data, cuts):
    machine, at, out = bpe.Utf8Machine(), 0, ""
    for c in sorted(min(c, len(data)) for c in cuts):
        out += machine.feed(data[at:c])
        at = c
    assert out + machine.feed(data[at:]) + machine.close() == data.decode("utf-8", "replace")


def test_streaming_decode_holds_back_cut_characters(codec):
    ids = codec.encode("日本 😀")
    parts = list(bpe.decode_stream(codec.tokens, ids))
    assert "".join(parts) == "日本 😀" and "�" not in "".join(parts)


def test_round_trip_of_odd_rows(library, odd, odd_rows, none):
    want = sorted(
        ((r[0], len(ids := library.encode_ordinary(r[1] or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in odd_rows),
        key=str,
    )
    assert sorted(map(tuple, bpe.round_trip(odd, PATH, public_tokenizers.PATTERN).collect()), key=str) == want
    assert bpe.round_trip(none, PATH, public_tokenizers.PATTERN).count() == 0
    docs = bpe.encode_documents(odd, PATH, public_tokenizers.PATTERN)
    assert "text" not in docs.columns and docs.count() == len(odd_rows)
    assert sum(r["n_tokens"] for r in docs.collect()) == sum(w[1] for w in want)
    clash = bpe.encode_documents(odd.withColumn("n_tokens", F.lit("own")), PATH, public_tokenizers.PATTERN)
    assert {r["n_tokens_given"] for r in clash.collect()} == {"own"} and clash.select("n_tokens").first()[0] >= 0


def greedy(begin, go_on, word):
    at = n = 0
    while at < len(word):
        pieces = go_on if at else begin
        stop = next((j for j in range(len(word), at, -1) if word[at:j] in pieces), None)
        if stop is None:
            return 1
        at, n = stop, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=5), max_size=12), st.sets(st.text("ab", min_size=1, max_size=5), max_size=12), st.text("abc", max_size=14))
def test_automaton_equals_greedy_longest_match(begin, go_on, word):
    a, b = {x.encode() for x in begin}, {x.encode() for x in go_on}
    assert maxmatch.Automaton(a, b).count(word.encode()) == greedy(a, b, word.encode())


def test_counts_of_odd_rows(odd, odd_rows, none):
    a, b = map(set, maxmatch.vocabulary(PATH))
    longest = max(map(len, a | b))

    def count(w):  # as greedy, trying no piece longer than any
        at = n = 0
        while at < len(w):
            at = next(j for j in range(min(len(w), at + longest), at, -1) if w[at:j] in (b if at else a))
            n += 1
        return n

    want = [(r[0], len(w := (r[1] or "").encode().split()), sum(map(count, w))) for r in odd_rows]
    assert sorted(map(tuple, maxmatch.count_tokens(odd, PATH).collect()), key=str) == sorted(want, key=str)
    assert maxmatch.count_tokens(none, PATH).count() == 0


def test_long_pieces_stream_in_bounded_memory(library, codec, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(bpe, "STRETCH", 16)
    for alphabet in ("ab", "abcdefghijklmnop", "éàü日", "=-*", "the of and"):
        piece = "".join(r.choice(alphabet) for _ in range(2000)).replace(" ", "").encode()
        parts = list(codec.transducer.stream(piece))
        assert [t for p in parts for t in p] == bpe.byte_pairs(codec.transducer.ranks, piece) and len(parts) > 50


def test_pairs_are_tested_without_merging_their_bytes(codec, monkeypatch):
    own = bpe.Codec(codec.transducer.ranks, public_tokenizers.PATTERN).transducer
    r = random.Random(9)
    ranks, tokens, calls = own.ranks, own.tokens, []
    # Halves of tokens meet rarely by chance, so cut tokens as well, and runs of one letter, whose merges tie.
    pairs = [(r.randrange(len(tokens)), r.randrange(len(tokens))) for _ in range(3000)]
    pairs += [(ranks[t[:k]], ranks[t[k:]]) for t in r.sample(sorted(ranks), 3000) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    runs = [i for i, t in tokens.items() if len(set(t)) == 1]
    pairs += [(a, b) for a in r.sample(runs, 60) for b in r.sample(runs, 60)]
    for a, b in r.sample(pairs, 2000):  # tokens that follow each other
        both = bpe.byte_pairs(ranks, tokens[a] + tokens[b])
        pairs += zip(both, both[1:], strict=False)
    want = [bpe.byte_pairs(ranks, tokens[a] + tokens[b]) == [a, b] for a, b in pairs]
    assert 0.1 < sum(want) / len(want) < 0.9
    for a, b in pairs:
        own.split(a), own.split(b)
    plain = bpe.byte_pairs
    monkeypatch.setattr(bpe, "byte_pairs", lambda *a: calls.append(a) or plain(*a))
    assert [own.fits(a, b) for a, b in pairs] == want
    # Only tokens that are halves of others are cut anew, each once.
    assert len(calls) == len(set(calls_of := [a[1] for a in calls])) and all(x in ranks for x in calls_of)


def test_ids_leave_in_small_batches(library, codec):
    texts = ["the of and" * (i % 3) for i in range(2000)] + [None]
    parts = list(bpe.ids_of(codec, [pa.array(texts, pa.string())]))
    assert max(map(len, parts)) <= 256
    assert [x for p in parts for x in p.to_pylist()] == [library.encode_ordinary(t or "") for t in texts]


def test_splits_alike_within_and_beyond_the_basic_plane(library, codec):
    text = "Don't naïve 日本語 １２ ½ \u2028\u3000 x\u00a0y  Ωmega\ufffd …—"
    for t in (text, text + " 𝒜𝒷 😀 𝟙𝟚", "𐐀" + text):
        assert codec.encode(t) == library.encode_ordinary(t)
    near, every = codec.near, codec.any
    assert near.findall(text) == every.findall(text) and len(near.pattern) < len(every.pattern)


def test_states_outlast_many_texts():
    """As many as tens of thousands of texts meet are kept, and a piece met before needs no new move; with fewer, most were made anew."""
    own = bpe.Transducer(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    r = random.Random(3)
    pieces = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=14)).encode() for _ in range(24_000)]
    first = [own.encode(p) for p in pieces]
    made = len(own.moves)
    assert len(own.states) > 90_000 and [own.encode(p) for p in pieces] == first and len(own.moves) == made
