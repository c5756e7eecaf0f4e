import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from touchline.llm import simhash, winnow


def simple_fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(items, bits):
    """items: (id, fingerprint); the smallest id that each reaches."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(items):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(items))]


def test_fingerprints_and_components_of_odd_rows(odd, odd_rows):
    got = sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str)
    items = [(r[0], simple_fingerprint(r[1] or "")) for r in odd_rows]
    want = sorted(((k, f"{fp:016x}", c) for (k, fp), c in zip(items, components(items, 2), strict=True)), key=str)
    assert got == want


def test_links_of_many_close_fingerprints(spark, monkeypatch):
    """Chains, a large ball around one fingerprint and random ones: the same components as all pairs give."""
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(300)}
    base = r.getrandbits(64)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)}
    chain = r.getrandbits(64)
    for _ in range(40):
        chain ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
        fps.add(chain)
    items = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in items], "fp long")
    edges = simhash.links(df, 2)
    assert edges.count() < 28 * len(items)
    monkeypatch.setattr(simhash, "MOST_CELL", 8)  # most cells are dealt again
    assert_components(edges, items)
    assert_components(simhash.links(df, 2), items)


def assert_components(edges, items):
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want, got = {}, {}
    for (i, f), c in zip(items, components(items, 2), strict=True):
        want.setdefault(c, set()).add(f)
        got.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_pivots_never_discard_a_link():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**64, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))
    assert np.abs(simhash.pivot_table(a) - simhash.pivot_table(b)).max() <= 2


def test_pivots_discard_before_any_exact_distance(spark, monkeypatch):
    """Of random fingerprints that share half their bits, the tables leave few pairs to verify; of links they leave all."""
    r = random.Random(3)
    high = r.getrandbits(32) << 32
    fps = np.array([high | r.getrandbits(32) for _ in range(1200)], dtype=np.uint64)
    fps = np.append(fps, fps[:10] ^ np.uint64(3))
    verified, real = [], simhash.verify
    monkeypatch.setattr(simhash, "verify", lambda a, b, bits: (verified.append(len(a)), real(a, b, bits))[1])
    assert len(simhash.bucket_links(fps, 2)) >= 10
    assert sum(verified) < 0.01 * len(fps) * (len(fps) - 1) / 2
    near = simhash.survivors(simhash.pivot_table(fps[:600]), simhash.pivot_table(fps[600:1200]), 2)
    assert near.mean() < 0.02


def test_joins_of_hot_keys_lose_no_row(spark):
    from touchline.llm.common import join_hot, materialize

    rows = [(None, 0)] * 50 + [(7, i) for i in range(900)] + [(8 + i % 30, i) for i in range(600)]
    left = materialize(spark.createDataFrame(rows, "k long, x long"))
    known = spark.createDataFrame([(k, f"n{k}") for k in range(7, 20)], "k long, name string")
    for share in (3, 20, 100000):
        for how in ("inner", "left"):
            want = sorted(map(str, left.join(known, "k", how).collect()))
            assert sorted(map(str, join_hot(left, known, "k", how, share).collect())) == want


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.deduplicate(none).count() == 0
    assert winnow.fingerprint_edits(none).count() == 0


def test_deduplicate_keeps_one_of_each_group(odd, odd_rows):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    items = [(r[0], simple_fingerprint(r[1] or "")) for r in odd_rows]
    want = {k for (k, _), c in zip(items, components(items, 2), strict=True) if k == c}
    got = [r["doc_id"] for r in kept.collect()]
    assert set(got) == want and len(got) == len(want)


def test_of_rows_equal_in_id_and_text_the_least_stays(spark):
    """Columns without an order (maps) go by their text."""
    rows = [(1, "one text of some words", {"b": 2}, [{"x": 1}]), (1, "one text of some words", {"a": 1}, None), (1, "one text of some words", {"a": 1}, [{"w": 1}]), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, meta map<string,int>, more array<map<string,int>>")
    assert sorted(map(tuple, simhash.deduplicate(df).collect()), key=str) == sorted([rows[1], rows[3]], key=str)


def simple_tokens(text):
    """By the words of the docstring, run by run."""
    import regex

    alone = winnow.ALONE.replace("\\x{", "\\u{")
    alone = regex.compile("[" + regex.sub(r"\\u\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), alone) + "]")
    out = []
    for run in regex.findall(r"[^\x20\x09-\x0D]+", text.lower()):
        at = 0
        while at < len(run):
            if alone.match(run, at):
                out.append(run[at])
                at += 1
                continue
            stop = next((i for i in range(at, len(run)) if alone.match(run, i)), len(run))
            own, last = run[at:stop].encode(), 0
            for i, x in enumerate(own):
                if stop - at > 12 and x < 0xC0 and x % 4 == 1:
                    out.append(own[last : i + 1].decode("latin-1"))
                    last = i + 1
            if last < len(own):
                out.append(own[last:].decode("latin-1") if stop - at > 12 else run[at:stop])
            at = stop
    return out


def simple_winnow(text, gram=4, window=8):
    """By definition, over the same token hashes: a true rolling hash, a minimum a window, rightmost of equal ones."""
    p, b = (1 << 31) - 1, 1_000_003
    h = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) % p for t in simple_tokens(text)]
    if not h:
        return []
    low, roll = [], 0
    for i, x in enumerate(h):
        roll = (roll * b + x) % p
        if i >= gram:
            roll = (roll - h[i - gram] * pow(b, gram, p)) % p
        if i >= gram - 1 or i == len(h) - 1:
            low.append(roll)
    out = []
    for i in range(max(1, len(low) - window + 1)):
        part = low[i : i + window]
        best = min(part)
        at = i + max(j for j, x in enumerate(part) if x == best)
        if (best, at) not in out:
            out.append((best, at))
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_winnowing_of_odd_texts(odd, odd_rows):
    got = winnow.winnow(odd.select("text"), "text", "fp").select("text", winnow.hashes("fp").alias("h"), winnow.positions("fp").alias("p"), "fp").collect()
    for r in got:
        want = simple_winnow(r["text"] or "")
        assert [(x >> 32, p) for x, p in zip(r["fp"], r["p"], strict=True)] == want
        assert r["h"] == list(dict.fromkeys(h for h, _ in want))


def test_a_shared_run_shares_a_hash(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    run = [word() for _ in range(11)]  # window + gram - 1 tokens
    rows = [(" ".join([word() for _ in range(r.randint(0, 30))] + run + [word() for _ in range(r.randint(0, 30))]),) for _ in range(20)]
    got = winnow.winnow(spark.createDataFrame(rows, "text string"), "text", "fp").select(winnow.hashes("fp").alias("h")).collect()
    assert all(set(a["h"]) & set(b["h"]) for a in got for b in got)


def test_a_shared_run_without_spaces_shares_a_hash_at_any_offset(spark):
    r = random.Random(11)
    between = lambda a, b: "".join(map(chr, range(ord(a), ord(b) + 1)))
    forms = {
        "ideographs": ("".join(map(chr, range(0x4E00, 0x4E80))), 11), "base64": (between("A", "Z") + between("a", "z") + between("0", "9") + "+/", None),
        "hexadecimal": ("0123456789abcdef", None), "consonants": ("bcdfghjklmnpqrstvwxyz", None), "digits": ("12346789", None), "greek": (between("α", "ω"), None),
        "cyrillic": (between("а", "я"), None), "arabic": (between("ا", "ي"), None), "devanagari": (between("अ", "ह"), None), "deseret": (between("𐐨", "𐑏"), None),
    }
    rows = []
    for name, (letters, length) in forms.items():
        text = lambda n, letters=letters: "".join(r.choice(letters) for _ in range(n))
        run = text(length or 40)
        while not length and sum(x < 0xC0 and x % 4 == 1 for x in run.lower().encode()) < 12:
            run += text(1)
        rows += [(name, text(r.randint(13, 60)) + run + text(r.randint(13, 60))) for _ in range(15)]
        rows += [(f"{name} one more", text(800))]
        rows += [(f"{name} one more", letters[0] + rows[-1][1])]
    got = winnow.winnow(spark.createDataFrame(rows, "form string, text string"), "text", "fp").select("form", winnow.hashes("fp").alias("h")).collect()
    for a in got:
        for b in got:
            if a["form"] == b["form"]:
                both = set(a["h"]) & set(b["h"])
                assert both and ("more" not in a["form"] or len(both) > 0.8 * len(a["h"]))


def test_rows_of_one_id_are_dealt_over_ranges_and_keep_their_order(spark, monkeypatch):
    """Two thirds of the rows have no id; each edited text ends in that of the next row in order."""
    r = random.Random(12)
    rows = [(None if i % 3 else i, " ".join(f"w{r.randrange(99)}" for _ in range(30))) for i in range(300)] + [(None, "the same text of eight words in all")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = winnow.fingerprint_edits(df)
    assert winnow._ranged(df, "doc_id", "text").select("range").distinct().count() > 10
    order = sorted(rows, key=lambda x: (-(x[0] if x[0] is not None else -(1 << 63)), -signed(xxhash.xxh64_intdigest(x[1].encode(), 42))))
    want = [(x[0], x[1][: len(x[1]) - len(x[1]) // 3] + y[1][: len(x[1]) // 3]) for x, y in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(map(str, want)) == sorted(str((x["doc_id"], x["edited"])) for x in got.collect())


def test_edits_take_from_the_next_document(odd, odd_rows):
    got = winnow.fingerprint_edits(odd).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("s"), "near_edited", "near_next").collect()
    order = sorted(odd_rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), -signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    want = []
    for i, r in enumerate(order):
        text, follow = r[1] or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + follow[:third]
        mine, other, beside = ({h for h, _ in simple_winnow(x)} for x in (text, edited, follow))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), like(mine, other), like(mine, beside)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
