"""Groups of near copies against brute force over exact likeness, and which row of a group stays."""

import random

import numpy as np
import pytest

from touchline.llm import simhash, similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS).repartition(4)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def word(r):
    return "".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 7)))


def brute(texts):
    """Group of each id by exact likeness and fingerprints within two bits."""
    sets = [(i, shingles(t), simhash.fingerprint(t.encode())) for i, t in texts]
    root = {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a, p) in enumerate(sets):
        for j, b, q in sets[:n]:
            both = len(a & b)
            if both >= 0.8 * (len(a) + len(b) - both) - 1e-9 or (p ^ q).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def groups(spark, texts):
    return {x["doc_id"]: x["component_id"] for x in similar.near_duplicates(frame(spark, texts)).collect()}


@pytest.mark.parametrize("rounds", [0, 2])
def test_variants_of_one_text_meet_their_original(spark, monkeypatch, rounds):
    """Variants are like the original and mostly not like each other; every link counts, whatever member of a key is met first."""
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    monkeypatch.setattr(similar, "BLOCK", 64)
    r = random.Random(2)
    base = [word(r) for _ in range(600)]
    texts = [(i, " ".join(w if i == 0 or r.random() > 0.018 else word(r) for w in base)) for i in range(250)]
    assert groups(spark, texts) == brute(texts)


def test_short_texts_that_differ_in_the_last_words(spark):
    """All pairs of a likeness of 0.8 or more, by brute force; every second text also has one very common line."""
    r = random.Random(4)
    line, texts = " ".join(word(r) for _ in range(9)), []
    for g in range(120):
        words = [word(r) for _ in range(r.choice([6, 12, 20, 30, 50, 58, 64]))]
        words = line.split() + words if g % 2 else words
        for c in range(3):
            texts.append((g * 3 + c, " ".join(words[:-1] + [word(r)] if c == 1 else words + [word(r)] * (c == 2))))
    want = brute(texts)
    assert sum(want[i] != i for i in want) > 100
    assert groups(spark, texts) == want


def test_links_are_exact(spark):
    """Pairs just above and just below the likeness: by one shingle of 300 texts' sets."""
    r = random.Random(5)
    texts = []
    for g in range(40):
        words = [word(r) for _ in range(304)]
        for c, cut in enumerate((0, 60 if g % 2 else 61)):
            texts.append((g * 2 + c, " ".join(words[: len(words) - cut])))
    got = groups(spark, texts)
    assert got == brute(texts) and sum(got[i] != i for i in got) == 20


def test_likely_pairs_by_definition():
    """Short and long sets in one group: all pairs of the wanted likeness are among those found, in one block and between two."""
    r = np.random.default_rng(4)
    sets = []
    for n in (1, 30, 400, 900, 1000, 1100, 1250, 3000):
        base = r.integers(0, 2**64, n, dtype=np.uint64)
        for keep in (1.0, 0.95, 0.9, 0.7):
            sets.append(np.unique(np.concatenate([base[: max(1, int(n * keep))], r.integers(0, 2**64, n - int(n * keep), dtype=np.uint64)])))
    n = np.array([len(s) for s in sets])
    short, long = zip(*[similar.fine(s, 0.8) for s in sets], strict=True)
    like = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    for left in (len(sets), 13):
        i, j = similar.likely(n, list(short), list(long), left, 0.8)
        got = set(zip(i.tolist(), j.tolist(), strict=True))
        every = [(a, b) for a in range(left) for b in (range(a + 1, len(sets)) if left == len(sets) else range(left, len(sets)))]
        assert {x for x in every if like(sets[x[0]], sets[x[1]]) >= 0.8} <= got and len(got) == len(i)
        assert all(like(sets[a], sets[b]) > 0.65 for a, b in got)


@pytest.mark.parametrize("dedup", [simhash.deduplicate, similar.deduplicate])
def test_null_and_repeated_ids_lose_no_group(spark, dedup):
    """Unlike texts with null or equal ids all stay; of a group one row stays, that with an id first."""
    r = random.Random(6)
    text = [" ".join(word(r) for _ in range(40)) for _ in range(30)]
    rows = [(None, text[i]) for i in range(10)] + [(7, text[i]) for i in range(10, 20)] + [(i, text[i]) for i in range(20, 30)]
    rows += [(None, text[25]), (None, text[3]), (9, text[4]), (7, text[12]), (99, text[12])]
    got = sorted((x["text"], x["doc_id"]) for x in dedup(frame(spark, rows)).collect() if x["doc_id"] is not None)
    assert got == sorted([(text[4], 9)] + [(text[i], 7) for i in range(10, 20)] + [(text[i], i) for i in range(20, 30)])
    assert sorted(x["text"] for x in dedup(frame(spark, rows)).collect() if x["doc_id"] is None) == sorted(text[i] for i in range(10) if i != 4)
