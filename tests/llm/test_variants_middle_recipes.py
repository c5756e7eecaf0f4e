"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.llm import fim, queries, recipes, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Spelling variants.


def simple_counts(rows, damage=31):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run if h % damage else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def simple_variants(n):
    """Words meet where they agree but for one code point, taken out or left open."""
    meet = {}
    for w in n:
        for i in range(len(w) + 1):
            meet.setdefault((w[:i], w[i:]), set()).add((w, 0))
        for i in range(len(w)):
            meet.setdefault((w[:i], w[i + 1 :]), set()).add((w, 1))
    near = {w: set() for w in n}
    for group in meet.values():
        for w, a in group:
            near[w] |= {x for x, b in group if x != w and (a or b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got_variants(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


def test_spelling_query_on_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = simple_variants(simple_counts(rows))
    assert got_variants(queries.op11_spelling_variants(spark, SF)) == want and len(want) > 300


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 7, "group_bytes": 1000}, {"shard_bytes": 60}])
def test_variants_of_close_words(spark, sizes):
    """Short alphabets make many neighbours, runs of one letter many equal edits, and counts that fall tenfold long chains. Tries and groups of any size agree."""
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choice("aÀÿ") for _ in range(r.randint(6, 8))) for _ in range(400))) for i in range(15)]
    chain = ["zzzzzzzz", "zzzzzzzy", "zzzzzzyy", "zzzzzyyy"]
    rows.append((99, " ".join(" ".join([w] * n) for w, n in zip(chain, (2500, 240, 22, 2), strict=True))))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    want = simple_variants(simple_counts(rows))
    assert got_variants(spelling.variants(df, **sizes)) == want
    assert max(v[3] for v in want.values()) > 5 and sum(v[1] != w and v[0] != v[1] for w, v in want.items()) >= 1


def test_variants_of_odd_tables(odd, odd_rows, none):
    assert got_variants(spelling.variants(odd)) == simple_variants(simple_counts([r[:2] for r in odd_rows]))
    assert spelling.variants(none).count() == 0


def test_very_long_words_take_linear_time(spark):
    long = "ab" * 30_000 + "a" * 40_000
    rows = [(i, f"{long} {long}x {long[:-1]} short", "en", "s", 0) for i in range(3)]
    got = got_variants(spelling.variants(spark.createDataFrame(rows, DOCS), damage=10**9))
    assert {len(w): v[3] for w, v in got.items()} == {100_000: 2, 100_001: 1, 99_999: 1}


def test_letters_are_cut_between_words():
    text = "wörter und ".encode("latin-1") * 1000
    assert b"".join(spelling.pieces(text, 100)) == text and len(list(spelling.pieces(text, 100))) > 50
    assert Counter(w for p in spelling.pieces(text, 100) for w in p.split()) == Counter(text.split())


# Fill in the middle.


def simple_middle(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def test_middle_of_odd_tables(spark, odd, odd_rows, none):
    marks = [(200 + i, t, "en", "s", 0) for i, t in enumerate(["a<P>b", "<S>", "x<M", "<<P", "P><S", "<M" + "é😀" * 3000])]
    df = odd.unionByName(spark.createDataFrame(marks, DOCS), allowMissingColumns=True)
    rows = [r[:2] for r in [*odd_rows, *marks]]
    out = fim.transform(df).withColumn("back", fim.restored()).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in out))) == sorted(str(simple_middle(*r)) for r in rows)
    assert sorted(r["back"] for r in out) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"} and fim.transform(none).count() == 0


def test_middle_query_on_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*x[:5], sha(x[5]), sha(t or "")) for x, (_, t) in ((simple_middle(*r), r) for r in rows)]
    got = queries.op12_fill_in_middle(spark, SF).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("every", [1, 2, 7, 1024])
@pytest.mark.parametrize("unit", [None, rb"\s+"])
def test_every_cut_is_found_from_its_checkpoint(every, unit, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 5)
    r = random.Random(every)
    for _ in range(30):
        text = "".join(r.choice("ab é😀日 ") for _ in range(r.randint(0, 60)))
        marks = fim.Checkpoints(text.encode(), every, re.compile(unit) if unit else None)
        ends = [0, *(m.end() for m in re.finditer(r"\s+", text))] if unit else list(range(len(text) + 1))
        ends += [len(text)] * (ends[-1] < len(text))
        assert (marks.units, marks.chars) == (len(ends) - 1, len(text))
        assert [marks.cut(u) for u in range(len(ends))] == [(len(text[:e].encode()), e) for e in ends]
        assert len(marks.at) <= 1 + len(ends) // every


# Exact duplicates.


def simple_groups(rows):
    plain = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    groups = {}
    for i, p in enumerate(plain):
        groups.setdefault(p, []).append(i)
    best = {p: min(g, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0, i)) for p, g in groups.items()}
    return sorted(((rows[i][0], rows[best[p]][0], len(groups[p]), sha(p)) for i, p in enumerate(plain)), key=str), len(groups)


def held(got, rows):
    got = got.collect()
    want, n = simple_groups(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == n and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("options", [{}, {"bits": 3, "least": 8, "most": 40}])
def test_duplicates_of_odd_tables(spark, odd, odd_rows, none, options):
    """Names of three bits, which most chunks share, give the same groups as names of 64."""
    base = odd_rows[45][1]
    more = [(300 + i, base.replace(" ", "  ", i), "en", "s", 0) for i in range(1, 6)] + [(400, base[:-1] + "?", "en", "s", 0), (401, "?" + base, "en", "s", 0)]
    df = odd.unionByName(spark.createDataFrame(more, DOCS), allowMissingColumns=True)
    held(recipes.exact_duplicates(df, **options), [r[:2] for r in [*odd_rows, *more]])
    assert recipes.exact_duplicates(none, **options).count() == 0


def test_duplicates_query_on_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    held(queries.op13_chunk_recipes(spark, SF), rows)


def test_hot_group_and_plan(spark):
    """A third of the rows in one group: found whole, without Python in the plan."""
    rows = [(i, ("the same text  " if i % 2 else "thesame text") if i % 3 == 0 else f"text {i}", "en", "s", 0) for i in range(3000)]
    out = recipes.exact_duplicates(spark.createDataFrame(rows, DOCS).repartition(5))
    held(out, [r[:2] for r in rows])
    assert "Python" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("letters", ["etaoinshrdlu", "бвгджзклмнпрст", "كتابقلمعربي", "कखगघचछजझ", "日本語中文字漢", "0123456789", "bcdfghjkmnpqrstvwxz"])
def test_chunks_are_cut_by_content_in_every_script(spark, letters):
    """Chunks give the text back, and all but the first few are the same with characters more in front."""
    r = random.Random(len(letters))
    text = "".join(r.choice(letters) for _ in range(60_000))
    df = spark.createDataFrame([(0, text), (1, "x" * 37 + text)], "i int, t string")
    a, b = (x["c"] for x in df.select("i", recipes.chunks("t").alias("c")).orderBy("i").collect())
    assert "".join(a).encode("latin-1").decode() == text
    assert all(recipes.LEAST <= len(c) <= recipes.MOST for c in a[:-1])
    assert len(set(a) & set(b)) >= 0.9 * len(a) > 5
