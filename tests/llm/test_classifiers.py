import itertools
import math
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from touchline.llm import brown, crf, knnvote, labelled
from touchline.llm.common import materialize

LABELS = "doc_id long, quality int, toxic int, score double"


def make(spark, n=600, seed=1):
    """Clean and toxic English-like texts and junk: toxic texts hold words of one family, junk repeats or shouts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 200))]
        good = int(i % 5 != 0)
        toxic = int(i % 7 == 0 and good)
        if toxic:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randrange(len(w)), "vexor" + r.choice("abcdef"))
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [w[0]] * len(w)
        docs.append((i, " ".join(w), "en", "src", 0))
        labels.append((i, good, toxic, 0.5))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), spark.createDataFrame(labels, LABELS)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize(("run", "label", "cut"), [(crf.score_toxicity, "toxic", 0.3), (knnvote.score_quality, "quality", 0.7)])
def test_held_out_accuracy(spark, run, label, cut):
    docs, labels = make(spark)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    got = run(docs, labels).collect()
    assert len(got) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in got)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) >= 0.95


@pytest.mark.parametrize("run", [crf.score_toxicity, knnvote.score_quality])
def test_odd_rows_and_missing_labels(spark, odd, odd_rows, none, run):
    docs, labels = make(spark, 200)
    labels = labels.unionByName(spark.createDataFrame([(1, None, None, 0.0), (None, 1, 1, 0.0), (2, 1, 1, 0.0), (2, 0, 0, 0.0)], LABELS))
    got = run(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in got if r["doc_id"] in (45, 46)]
    assert len(same) == 3 and len(set(same)) == 1
    assert run(none, labels).count() == 0
    assert all(0 <= r["score"] <= 1 for r in run(docs, labels.limit(0)).collect())


def test_held_out_labels_are_never_learned(spark):
    docs, labels = make(spark, 200)
    assert not [t for t, _ in labelled.sample(docs.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"), labels, "toxic", rows=1000)]
    assert len(labelled.sample(docs, labels, "toxic", rows=10, share=0.5)) == 10


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(4)
    trans, init = np.array([[0.9, 0.1], [0.4, 0.6]]), np.array([0.8, 0.2])
    lengths = [1, 5, 2, 9, 1]
    logits = r.normal(0, 3, sum(lengths))
    starts = np.zeros(len(logits), bool)
    starts[np.cumsum([0, *lengths[:-1]])] = True
    got, pairs, first = crf.forward_backward(logits, starts, trans, init, pairs=True)
    want, both, begin, at = [], np.zeros((2, 2)), np.zeros(2), 0
    for n in lengths:
        weight, one, own = 0.0, np.zeros(n), np.zeros((2, 2))
        start = np.zeros(2)
        for path in itertools.product((0, 1), repeat=n):
            p = init[path[0]] * math.exp(sum(logits[at + i] for i in range(n) if path[i]))
            p *= math.prod(trans[a, b] for a, b in zip(path, path[1:], strict=False))
            weight += p
            one += p * np.array(path)
            start[path[0]] += p
            for a, b in zip(path, path[1:], strict=False):
                own[a, b] += p
        want += list(one / weight)
        both += own / weight
        begin += start / weight
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, both) and np.allclose(first, begin)


@pytest.mark.parametrize("part", [1, 7, 64])
def test_marginals_part_by_part_are_those_of_the_whole(part):
    r = np.random.default_rng(5)
    trans, init = np.array([[0.98, 0.02], [0.3, 0.7]]), np.array([0.9, 0.1])
    logits, starts = r.normal(0, 4, 500), r.random(500) < 0.02
    starts[0] = True
    assert np.allclose(crf.marginals(logits, starts, trans, init, part), crf.forward_backward(logits, starts, trans, init))


LONG = """
import resource, numpy as np
from touchline.llm import crf, knnvote
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
model = crf.Model({}, -5.0, np.array([[0.98, 0.02], [0.9, 0.1]]), np.array([0.98, 0.02]), np.zeros(4))
text = b"some words " * 2_500_000
before = peak()
logits, starts = crf._logits([text], crf._Cache(model.emission))
p = crf.marginals(logits, starts, model.transition, model.initial)
assert len(p) == 5_000_000 and crf._offsets(text, [4_999_999])[0]["stop"] == len(text) - 1
assert len(knnvote.counted([text], knnvote._Terms())[0])
print(peak() - before)
"""


def test_one_text_of_five_million_words_takes_bounded_memory():
    """Less than 400 MB beyond the text's own 27 MB."""
    done = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True, timeout=300, check=True, cwd=Path(__file__).parents[2])
    assert int(done.stdout) < 400


def test_extreme_logits_do_not_overflow():
    p = crf.forward_backward(np.array([800.0, -800.0, 0.0] * 50), np.arange(150) % 30 == 0, np.array([[0.99, 0.01], [0.5, 0.5]]), np.array([0.9, 0.1]))
    assert np.isfinite(p).all() and p[0] > 0.99 and p[1] < 0.01


def test_spans_are_the_toxic_tokens(spark):
    docs, labels = make(spark)
    hit = total = 0
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in crf.score_toxicity(docs, labels).filter("held_out").collect():
        words = [text[r["doc_id"]].encode()[s["start"] : s["stop"]] for s in r["spans"]]
        hit += sum(w.startswith(b"vexor") for w in words)
        total += len(words)
    assert total and hit / total > 0.95


def test_cosines_and_votes_by_definition(spark):
    docs, labels = make(spark, 200)
    model = knnvote.fit_quality(docs, labels)
    x = model.vectors[:7]
    got = knnvote.vote(model, x, 5)
    for v, score in zip(x, got, strict=True):
        cos = model.vectors @ v
        near = np.argsort(-cos)[:5]
        w = np.maximum(cos[near], 0).astype(float) ** 4
        assert score == pytest.approx(((w * model.labels[near]).sum() + 0.02 * model.prior) / (w.sum() + 0.02), abs=1e-5)


def test_brown_base_scores_and_counts(odd, odd_rows):
    counts: Counter = Counter()
    for r in odd_rows:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1:
            counts.update((r[1] or "").encode().lower().split())
            counts[b""] += 1
    total, distinct = sum(counts.values()), len(counts)
    got = brown.score_documents(odd, type_words=20, type_endings=20, classes=8, known_words=15, least_count=1).collect()
    assert len(got) == len(odd_rows)
    rows = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str)
    want = []
    for r in odd_rows:
        tokens = [*(r[1] or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        want.append((r[0], len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6)))
    assert rows == sorted(want, key=str)


@pytest.mark.parametrize("known_words", [11, 30, 1000])
def test_brown_scores_by_definition(odd, odd_rows, known_words):
    """The model's score of every text, recomputed word by word from the classes alone."""
    sizes = {"type_words": 10, "type_endings": 10, "classes": 6, "known_words": known_words, "least_count": 2}
    train = odd.filter("pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 5) <> 1").selectExpr("coalesce(cast(text as binary), cast('' as binary)) as t")
    counted = materialize(brown.count_words(train))
    model = brown.fit(train, counted, **sizes)
    names = brown.Classes(model.words, model.endings, model.other)
    cls = lambda w: int(model.classes[names[w]]) if names[w] < len(model.words) else names[w] - len(model.words)
    lines = [(r[1] or "").encode().lower().split() + [b""] for r in odd_rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    words = Counter(w for line in lines for w in line)
    flow = Counter((cls(a), cls(b)) for line in lines for a, b in zip([b"", *line], line, strict=False))
    k = len(model.emission)
    tokens, kinds, into, out = (Counter() for _ in range(4))
    for w, c in words.items():
        tokens[cls(w)] += c
        kinds[cls(w)] += 1
    for (a, b), c in flow.items():
        out[a] += c
        into[b] += c
    n = sum(flow.values())
    want = []
    for r in odd_rows:
        line, score = (r[1] or "").encode().lower().split() + [b""], 0.0
        for a, b in zip([b"", *line], line, strict=False):
            x, y = cls(a), cls(b)
            score += math.log10((flow[x, y] + 20 * (into[y] + 1) / (n + k)) / (out[x] + 20))
            score += math.log10((words[b] + 0.5) / (tokens[y] + 0.5 * (kinds[y] + 1)))
        want.append((str(r[0]), round(score, 4)))
    got = brown.score_documents(odd, **sizes).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in got) == sorted(want)


def test_brown_places_words_beyond_the_types_by_their_neighbours(spark):
    """Rare nouns and verbs without telling endings come into the classes of the frequent ones."""
    r = random.Random(3)
    nouns, verbs = [[f"{x}{i}qq" for i in range(40)] for x in "nv"]
    weight = [1 / (i + 1) for i in range(40)]
    rows = [(i, " ".join(w for _ in range(40) for w in (r.choices(nouns, weight)[0], r.choices(verbs, weight)[0]))) for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("cast(text as binary) as t").repartition(3)
    model = brown.fit(train, materialize(brown.count_words(train)), classes=3, type_words=16, type_endings=4, known_words=1000, least_count=5)
    of = dict(zip(model.words, model.classes.tolist(), strict=True))
    assert len({of[w.encode()] for w in nouns}) == len({of[w.encode()] for w in verbs}) == 1 and of[b"n0qq"] != of[b"v0qq"]


def test_gains_are_those_of_the_exchange():
    """The class that gains() finds is that of the largest mutual information, by definition."""
    r = np.random.default_rng(6)
    table = r.integers(0, 40, (5, 5)).astype(float)
    info = lambda t: sum(t[i, j] * math.log(t[i, j] * t.sum() / (t[i].sum() * t[:, j].sum())) for i in range(5) for j in range(5) if t[i, j])
    word, slot, n = [], [], []
    want = []
    for w in range(12):
        into, out = r.integers(0, 3, 5), r.integers(0, 3, 5)
        into[0] += 1
        for c in range(5):
            for side, x in ((0, into), (1, out)):
                if x[c]:
                    word.append(w), slot.append(side * 5 + c), n.append(float(x[c]))
        scores = []
        for c in range(1, 5):
            t = table.copy()
            t[:, c] += into
            t[c, :] += out
            scores.append(info(t))
        want.append(1 + int(np.argmax(scores)))
    order = np.lexsort((slot, word))
    words, best = brown.gains(table, np.array(word)[order], np.array(slot)[order], np.array(n)[order])
    assert words.tolist() == list(range(12)) and best.tolist() == want


def test_brown_beats_words_alone_on_held_out_text(spark):
    r = random.Random(2)
    nouns, verbs = [f"n{i}x" for i in range(60)], [f"v{i}y" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(w for _ in range(40) for w in (r.choice(nouns), r.choice(verbs)))) for i in range(300)], "doc_id long, text string")
    got = {x["held_out"]: x for x in brown.perplexity(brown.score_documents(docs, classes=6)).collect()}
    assert got[True]["perplexity"] < 0.75 * got[True]["base_perplexity"]


def test_brown_without_documents(none):
    assert brown.score_documents(none).count() == 0


def test_exchange_finds_planted_classes():
    r = np.random.default_rng(0)
    of = np.r_[0, r.integers(1, 4, 60)]
    table = np.zeros((61, 61))
    flow = np.array([[0, 5, 0, 0], [0, 0, 9, 1], [0, 1, 0, 9], [5, 9, 1, 0]])
    for a in range(61):
        for b in range(61):
            table[a, b] = r.poisson(flow[of[a], of[b]])
    a, b = np.nonzero(table)
    got = brown.exchange(a, b, table[a, b], 61, 4)
    assert len({(x, y) for x, y in zip(of, got, strict=True)}) == 4


def test_toxic_features_and_ratio_by_definition():
    """Features that tell toxic documents, and the ratio that does so best across halves, counted with sets."""
    r = random.Random(11)
    y = [int(i % 5 == 0) for i in range(240)]  # some in either half
    own = [{r.randrange(60) for _ in range(15)} | ({100 + r.randrange(8)} if label and r.random() < 0.8 else set()) | ({100 + r.randrange(8)} if r.random() < 0.02 else set()) for label in y]

    def known(docs, labels, ratio):
        n1, n0 = max(1, sum(labels)), max(1, len(labels) - sum(labels))
        out = set()
        for f in set().union(*docs):
            a, b = (sum(f in d for d, label in zip(docs, labels, strict=True) if label == want) for want in (1, 0))
            rate = (a + b) / (n1 + n0)
            score = 2 * sum(x * math.log(x / (n * rate)) for x, n in ((a, n1), (b, n0)) if x)
            if a and a / n1 >= 20 * (b + 0.1) / n0 and score >= ratio:
                out.add(f)
        return out

    arrays = [np.array(sorted(d), dtype=np.int32) for d in own]
    f1 = []
    for ratio in crf.RATIOS:
        assert set(np.flatnonzero(crf.toxic_features(arrays, np.array(y), ratio)).tolist()) == known(own, y, ratio)
        right = wrong = missed = 0
        for h in (0, 1):
            told = known(own[h::2], y[h::2], ratio)
            for d, label in zip(own[1 - h :: 2], y[1 - h :: 2], strict=True):
                hit = bool(d & told)
                right, wrong, missed = right + (hit and label), wrong + (hit and not label), missed + (not hit and label)
        f1.append(2 * right / max(1, 2 * right + wrong + missed))
    assert len(set(f1)) > 1
    assert crf.choose_ratio(arrays, np.array(y)) == crf.RATIOS[f1.index(max(f1))]


def test_toxicity_scores_and_spans_by_definition(spark, odd):
    """Every document's score and spans, token by token from the fitted model's weights alone."""
    docs, labels = make(spark, 200)
    model = crf.fit(labelled.sample(docs, labels, "toxic", rows=4000, share=0.25))
    rows = docs.unionByName(odd.select(docs.columns))

    def plain(text):
        tokens = list(crf.TOKEN.finditer(text))
        e = [math.exp(model.bias + sum(model.weights.get(f, 0.0) for f in crf.features(m.group().lower()))) for m in tokens]
        ahead, behind = [], [(1.0, 1.0)]
        for i, x in enumerate(e):
            a0, a1 = model.initial if i == 0 else [sum(ahead[-1][k] * model.transition[k][j] for k in (0, 1)) for j in (0, 1)]
            ahead.append((a0 / (a0 + a1 * x), a1 * x / (a0 + a1 * x)))
        for x in e[:0:-1]:
            b = [model.transition[k][0] * behind[-1][0] + model.transition[k][1] * x * behind[-1][1] for k in (0, 1)]
            behind.append((b[0] / sum(b), b[1] / sum(b)))
        p = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, behind[::-1], strict=False)]
        facts = [1.0, max(p), math.log1p(sum(p)), math.log1p(100 * sum(p) / len(p))] if p else [1.0, 0.0, 0.0, 0.0]
        z = sum(w * x for w, x in zip(model.document, facts, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), [(m.start(), m.end()) for m, x in zip(tokens, p, strict=True) if x >= 0.5]

    got = crf.tag(rows, model)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 7), [(s["start"], s["stop"]) for s in r["spans"]], r["predicted"]) for r in got.collect()), key=str)
    want = []
    for r in rows.collect():
        score, spans = plain((r["text"] or "").encode())
        want.append((r["doc_id"] is None, r["doc_id"] or 0, round(score, 7), spans, int(score >= crf.THRESHOLD)))
    want = sorted(want, key=str)
    assert len(got) == len(want) and any(x[3] for x in got)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[3:] == b[3:] and a[2] == pytest.approx(b[2], abs=1e-6)
