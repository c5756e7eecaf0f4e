import random

from touchline.llm import similar


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def word(r):
    return "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7)))


def edited(r, words, share):
    return [word(r) if r.random() < share else w for w in words]


def test_groups_of_near_copies_and_clean_documents(spark):
    """Every pair of a likeness of 0.82 or more is in one group; no group has a document unlike all its others; shared passages link nothing."""
    r = random.Random(6)
    passage = [word(r) for _ in range(60)]
    docs = {}
    for g in range(12):
        base = [word(r) for _ in range(r.choice([40, 120, 400]))]
        for c in range(6):
            docs[g * 10 + c] = " ".join(base if c == 0 else edited(r, base, r.choice([0.0, 0.005, 0.01, 0.05])))
    for i in range(200, 260):
        own = [word(r) for _ in range(150)]
        docs[i] = " ".join(own[:70] + passage + own[70:])
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    group = {x["doc_id"]: x["component_id"] for x in similar.near_duplicates(df).collect()}
    pairs = [(a, b) for a in docs for b in docs if a < b and likeness(docs[a], docs[b]) >= 0.82]
    assert len(pairs) > 60 and sum(group[a] == group[b] for a, b in pairs) / len(pairs) >= 0.97
    for a in docs:
        if group[a] != a:
            assert max(likeness(docs[a], docs[b]) for b in docs if b != a and group[b] == group[a]) > 0.7
    assert all(group[i] == i for i in range(200, 260))
    kept = similar.deduplicate(df)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(set(group.values()))


def test_estimates_are_near_the_likeness():
    r = random.Random(3)
    hashes = similar._Hashes()
    a, b = [], []
    for _ in range(60):
        base = [word(r) for _ in range(300)]
        a.append(" ".join(base))
        b.append(" ".join(edited(r, base, r.random() * 0.05)))
    sketches = [[similar.profile(t.encode(), hashes)[1] for t in x] for x in (a, b)]
    got = similar.alike(*sketches)
    assert max(abs(g - likeness(x, y)) for g, x, y in zip(got, a, b, strict=True)) < 0.12


def test_odd_and_empty_tables(odd, odd_rows, none):
    got = similar.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    group = {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None}
    assert group[45] == group[46] == 45 and group[40] == group[41] == group[42] == 40
    assert similar.near_duplicates(none).count() == 0 and similar.deduplicate(none).count() == 0
