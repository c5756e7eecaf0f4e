"""The registered queries over whole small tables, against the words of their contracts."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from test_duplicates import components, simple_fingerprint, simple_winnow
from test_mix_and_secrets import simple_base, simple_targets, words
from test_whole_groups import brute

from touchline.llm import queries
from touchline.llm.common import table

DIR = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DIR, "documents").collect()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, DIR).collect()}


def test_winnowing(spark, docs):
    got = rows(spark, "op2_winnowing")
    order = sorted(docs, key=lambda r: -r["doc_id"])
    assert len(got) == len(order)
    as_text = lambda text: ",".join(f"{h:08X}{0xFFFFFFFF - at:08X}" for h, at in simple_winnow(text))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, r in enumerate(order):
        text, follow = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + follow[:third]
        x = got[r["doc_id"]]
        assert (x["n_chars"], x["edited_sha256"], x["fingerprint"], x["edited_fingerprint"]) == (len(text), sha(edited), as_text(text), as_text(edited))
        own, other, beside = ({h for h, _ in simple_winnow(t)} for t in (text, edited, follow))
        assert (x["near_edited"], x["near_next"]) == pytest.approx((like(own, other), like(own, beside)))


def test_simhash(spark, docs):
    got = rows(spark, "op3_simhash_near_duplicates")
    items = [(r["doc_id"], simple_fingerprint(r["text"] or "")) for r in docs]
    assert {k: (x["fingerprint"], x["component_id"]) for k, x in got.items()} == {k: (f"{f:016x}", c) for (k, f), c in zip(items, components(items, 2), strict=True)}


@pytest.mark.parametrize(("name", "cut"), [("op4_toxicity_crf", 0.3), ("op5_quality_neighbours", 0.7)])
def test_classifiers(spark, docs, name, cut):
    got = rows(spark, name)
    assert set(got) == {r["doc_id"] for r in docs}
    for k, x in got.items():
        assert x["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= cut)
    if name == "op4_toxicity_crf":
        texts = {r["doc_id"]: r["text"] or "" for r in docs}
        for k, x in got.items():
            spans = [tuple(map(int, s.split(":"))) for s in x["spans"].split(",") if s]
            assert spans == sorted(spans) and all(0 <= a < b <= len(texts[k]) for a, b in spans)


def test_base_of_the_language_model(spark, docs):
    counts = Counter()
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            counts.update([*(r["text"] or "").encode().lower().split(), b""])
    total, distinct = sum(counts.values()), len(counts)
    got = rows(spark, "op6_brown_class_bigram")
    assert len(got) == len(docs)
    for r in docs:
        tokens, x = [*(r["text"] or "").encode().lower().split(), b""], got[r["doc_id"]]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1, len(tokens), sum(t in counts for t in tokens), total)
        assert x["base_score"] == pytest.approx(base) and -math.inf < x["score"] < 0


def test_word_pieces(spark, docs):
    got = rows(spark, "op7_longest_match_counts")
    assert {k: x["n_words"] for k, x in got.items()} == {r["doc_id"]: words(r["text"]) for r in docs}


def test_byte_pairs(spark, docs, library):
    got = rows(spark, "op8_byte_bpe")
    for r in docs:
        ids = library.encode_ordinary(r["text"] or "")
        assert tuple(got[r["doc_id"]])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(r["text"] or ""))


def test_secrets(spark, docs):
    got = rows(spark, "op10_secret_ownership")
    for r in docs:
        base, x = simple_base(r["text"] or ""), got[r["doc_id"]]
        assert [x[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert x["base_sha256"] == sha(",".join(base)) and set(base) <= set(x["spans"].split(",") if x["spans"] else [])


def test_stages_of_the_pipeline(spark, docs, library):
    """Groups, secrets, mix and tokens by brute force, each on what the stage before it kept."""
    stages = [s for _, s in corpus_pipeline.STAGES]
    good = stages[0](spark, table(spark, DIR, "documents"), DIR).cache()
    texts = [(r["doc_id"], r["text"] or "") for r in good.collect()]
    single = stages[1](spark, good, DIR).cache()
    assert sorted(r["doc_id"] for r in single.select("doc_id").collect()) == sorted(set(brute(texts).values()))
    clean = stages[2](spark, single, DIR).cache()
    was, now = ({r["doc_id"]: r["text"] or "" for r in df.collect()} for df in (single, clean))
    assert set(was) == set(now)
    for k, text in was.items():
        secret = [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in simple_base(text))]
        assert not any(s in now[k] for s in secret)
    mixed = stages[3](spark, clean, DIR).cache()
    size, left = Counter(), Counter()
    for df, into in ((clean, size), (mixed, left)):
        for r in df.select("source", "text").collect():
            into[r["source"]] += words(r["text"])
    largest = max(words(t) for t in now.values())
    assert all(abs(left[s] - target) <= largest for s, target in simple_targets(size).items())
    sent = stages[4](spark, mixed, DIR).collect()
    want = sorted((r["doc_id"], library.encode_ordinary(r["text"] or "")) for r in mixed.collect())
    assert sorted((r["doc_id"], list(r["token_ids"])) for r in sent) == want
