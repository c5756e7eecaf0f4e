"""Spelling variants: words within one edit of each other, found by intersecting each word's Levenshtein automaton with tries of all words.

1. Words are counted in tasks and summed by word; the table is written and never collected.
2. The words are dealt into ranges, and each range is cut into compact tries of at most SHARD_WORDS words and SHARD_BYTES letters, whatever the input: one byte of
   label, one number of a first child and one count a node, children side by side.
3. Tries are broadcast, at most GROUP_BYTES at a time; within each group every word's automaton of distance one walks every trie depth-first. One row a word
   comes out: how many neighbours, and the best of them. A word's rows of several groups are summed.
4. Roots: links to forms double until none changes. Counts grow tenfold along a link, so twice as long a chain needs one more turn of at most five.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import materialize, slices, tidy

#: Words have at least so many letters and occurrences; one of DAMAGE words in a document loses a letter; a form is RATIO times as frequent.
LETTERS, OCCURRENCES, DAMAGE, RATIO = 7, 2, 31, 10
#: Letters are A-Z, a-z and U+00C0 to U+00FF: single bytes of Latin-1, in the order of their code points.
LETTER = rb"A-Za-z\xC0-\xFF"
NO_LETTER = re.compile(rb"[^" + LETTER + rb"]")
#: Letters of a text that are matched at one time, and distinct words that a task holds.
PIECE, FLUSH = 1 << 20, 200_000
#: Words whose neighbours a task looks for.
TASK_WORDS = 8192
#: The bounds of a trie, and of the tries that are broadcast at one time.
SHARD_WORDS, SHARD_BYTES, GROUP_BYTES = 1 << 16, 1 << 21, 48 << 20


def pieces(letters: bytes, most: int = PIECE) -> Iterator[bytes]:
    """A text in Latin-1 in pieces of some ``most`` bytes, cut where there is no letter."""
    at = 0
    while len(letters) - at > most:
        end = NO_LETTER.search(letters, at + most)
        if end is None:
            break
        yield letters[at : end.start()]
        at = end.start()
    yield letters[at:] if at else letters


def damaged(word: bytes, seed: int, damage: int = DAMAGE) -> bytes:
    """The word without one letter if its checksum, carried on from ``seed``, says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
    return word if h % damage else word[: (i := h % len(word))] + word[i + 1 :]


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, damage: int = DAMAGE) -> DataFrame:
    """word (Latin-1 bytes), n: occurrences in all texts, A-Z lower-cased and damaged by document. Shorter words are left out: damage makes none longer."""
    run = re.compile(rb"[" + LETTER + rb"]{%d,}" % letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return got

        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                for doc_id, text in zip(batch.column(0).slice(at, len(part)).to_pylist(), part, strict=True):
                    seed, own = zlib.crc32(f"{doc_id}:".encode()), Counter()
                    for piece in pieces(text.encode("latin-1", "replace")):  # characters beyond Latin-1 are no letters here
                        own.update(run.findall(piece.lower()))
                        if len(own) > FLUSH:
                            break_off(own, seed, seen)
                    break_off(own, seed, seen)
                    if len(seen) > FLUSH:
                        yield out()
                at += len(part)
        yield out()

    def break_off(own: Counter, seed: int, seen: Counter) -> None:
        for word, n in own.items():
            word = damaged(word, seed, damage)
            if len(word) >= letters:
                seen[word] += n
        own.clear()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """Sorted words with counts as three arrays: a node's children stand side by side from first[node] up to first[node + 1], under their labels."""

    def __init__(self, label: bytes, first: array, n: array):
        self.label, self.first, self.n = label, first, n

    @staticmethod
    def of(words: list[bytes], counts: list[int]) -> Trie:
        """From distinct words in order, by breadth: each node is a stretch of words with a common prefix."""
        label, first, n = bytearray(1), array("i", [1]), array("q")
        level, depth = [(0, len(words))], 0
        while level:
            below = []
            for lo, hi in level:
                ends = lo < hi and len(words[lo]) == depth
                n.append(counts[lo] if ends else 0)
                lo += ends
                while lo < hi:
                    c, at = words[lo][depth], lo + 1
                    while at < hi and words[at][depth] == c:
                        at += 1
                    label.append(c)
                    below.append((lo, at))
                    lo = at
                first.append(len(label))
            level, depth = below, depth + 1
        return Trie(bytes(label), first, n)

    def packed(self) -> bytes:
        return len(self.label).to_bytes(8, "little") + self.label + self.first.tobytes() + self.n.tobytes()

    @staticmethod
    def unpacked(data: bytes) -> Trie:
        size = int.from_bytes(data[:8], "little")
        at = 8 + size
        first, n = array("i"), array("q")
        first.frombytes(data[at : at + 4 * (size + 1)])
        n.frombytes(data[at + 4 * (size + 1) :])
        return Trie(data[8:at], first, n)

    def near(self, word: bytes) -> Iterator[tuple[int, bytes]]:
        """(n, neighbour) of each word of the trie at a distance of exactly one.

        The automaton has read a prefix without an error (one state a depth, the trie's path of the word) or with one (then the rest must follow letter by
        letter). Of equal edits one is walked: a letter goes from the head of its run, and comes in before another letter only.
        """
        find, first, label, n = self.label.find, self.first, self.label, self.n
        node, size, last = 0, len(word), -1
        for i in range(size + 1):
            lo, hi = first[node], first[node + 1]
            c = word[i] if i < size else -1
            if c >= 0 and c != last:  # without word[i]
                v, j = node, i + 1
                while v >= 0 and j < size:
                    v = find(word[j], first[v], first[v + 1])
                    j += 1
                if v >= 0 and n[v]:
                    yield n[v], word[:i] + word[i + 1 :]
            for u in range(lo, hi):
                x = label[u]
                if x == c:
                    continue
                v, j = u, i  # x before word[i]
                while v >= 0 and j < size:
                    v = find(word[j], first[v], first[v + 1])
                    j += 1
                if v >= 0 and n[v]:
                    yield n[v], word[:i] + bytes((x,)) + word[i:]
                if c >= 0:
                    v, j = u, i + 1  # x instead of word[i]
                    while v >= 0 and j < size:
                        v = find(word[j], first[v], first[v + 1])
                        j += 1
                    if v >= 0 and n[v]:
                        yield n[v], word[:i] + bytes((x,)) + word[i + 1 :]
            if c < 0:
                return
            last, node = c, find(c, lo, hi)
            if node < 0:
                # No word has this prefix, but one that drops a letter already read was tried above; nothing further on is reached without an error.
                return


def tries(words: DataFrame, *, shard_words: int = SHARD_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """trie (packed), size: all words of column word with their n, each in one trie."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[bytes] = []
        counts: list[int] = []
        held = 0

        def out() -> pa.RecordBatch:
            data = Trie.of(own, counts).packed()
            own.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], names=["trie", "size"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own and (len(own) == shard_words or held + len(word) > shard_bytes):
                    yield out()
                    held = 0
                own.append(word)
                counts.append(n)
                held += len(word)
        if own:
            yield out()

    return words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(build, "trie binary, size long")


def neighbours(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """word, n, n_near, near_n, near of each word: its neighbours in the tries, and of these the most frequent, the smallest of equals."""
    shared = words.sparkSession.sparkContext.broadcast(tries)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Trie.unpacked(x) for x in shared.value]
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near, best_n, best = 0, 0, None
                for trie in own:
                    for m, x in trie.near(word):
                        near += 1
                        if m > best_n or m == best_n and x < best:
                            best_n, best = m, x
                rows.append((word, n, near, best_n, best))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["word", "n", "n_near", "near_n", "near"])
        tidy()

    return words.select("word", "n").mapInArrow(walk, "word binary, n long, n_near long, near_n long, near binary")


def grouped(tries: DataFrame, most: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """Written tries in groups of at most ``most`` bytes, or one trie; the driver holds one group at a time."""
    group, size = [], 0
    for r in tries.toLocalIterator():
        if group and size + r["size"] > most:
            yield group
            group, size = [], 0
        group.append(bytes(r["trie"]))
        size += r["size"]
    if group:
        yield group


def rooted(links: DataFrame) -> DataFrame:
    """word, root of links word -> form: the last of the chain. Chains have an end, as counts grow along them."""
    links = materialize(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(onward, "root", "left_semi").isEmpty():
            return links
        links = materialize(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms")


def text(c: str) -> Column:
    return F.decode(F.col(c), "ISO-8859-1").alias(c)


def variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, damage: int = DAMAGE, ratio: int = RATIO,
    shard_words: int = SHARD_WORDS, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word.

    Null texts have no words; a null id counts as the empty text, rows of one id are damaged alike, repeated rows count each time; an empty table has no
    words. Words of any length take part. Ties of the most frequent neighbour go to the smallest in code-point order.
    """
    words = count_words(docs, id_col=id_col, text_col=text_col, letters=letters, damage=damage).filter(F.col("n") >= occurrences)
    words = materialize(words, "words")
    shards = materialize(tries(words, shard_words=shard_words, shard_bytes=shard_bytes), "tries")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() // TASK_WORDS)
    dealt = words.repartition(tasks, "word")  # so many tasks, as the table is small for the work that it makes
    parts = [materialize(neighbours(dealt, group), "near") for group in grouped(shards, group_bytes)]
    if not parts:
        parts = [neighbours(words, [])]
    near = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            near = near.unionByName(more)
        # Largest count first, then the smallest word: complements order the counts the other way.
        best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), "near")))
        near = near.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
        near = near.select("word", "n", "n_near", (-F.col("b.m")).alias("near_n"), "b.near")
    is_form = F.col("near").isNotNull() & (F.col("near_n") >= ratio * F.col("n"))
    out = near.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    out = out.join(rooted(out.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select(text("word"), text("form"), text("root"), "n", "n_near", "form_n")
