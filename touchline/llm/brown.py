"""Language-model scores by a Brown class-based bigram: P(word | previous) = P(class | previous class) P(word | class).

1. Word counts over all training texts: counted in each task, summed by word. They grow with the corpus and are never collected.
2. Exchange clustering of the ``type_words`` most frequent words and the ``type_endings`` most frequent endings (last three bytes) of all others: bigram
   counts of these types, at most their number squared, from all training texts; one type at a time moves to the class that gains most mutual information between neighbours.
3. Every other of the ``known_words`` most frequent words makes the same move once, distributed: classes of its neighbours are counted over all
   training texts and dealt by word, and the word goes to the class of the largest gain. Words beyond have the class of their ending.
4. Transitions are counted over all training texts by these classes, smoothed by class frequencies; emissions are smoothed counts.
5. Scoring: counts and classes of the ``known_words`` are broadcast (a bounded table); each text is scored against them
   in one pass, and its other words go to the written counts by a join on the word. Frequent words are never shuffled, so the joined words are
   each less than one in ``known_words`` of the training tokens, and their repeats in a text count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import fold, materialize, slices, text_bytes
from touchline.llm.common import words as parts_of

FOLDS, HELD_OUT = 5, 1
CLASSES = 64
TYPE_WORDS = 4096
TYPE_ENDINGS = 256
KNOWN_WORDS = 150_000
#: Words with fewer occurrences in training texts have the class of their ending: their neighbours are too few to tell. A word that is exchanged is weighed
#: again and again among all others, and needs fewer than one that moves once.
LEAST_EXCHANGED, LEAST_COUNT = 25, 100
FLUSH = 200_000
#: The end of a text in the counts; words are never empty.
END = b""
END_TYPE, OTHER_TYPE = 0, 1


def count_words(train: DataFrame) -> DataFrame:
    """word, n of all words of column t, the end of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return got

        for batch in batches:
            for part in slices(batch.column(0)):
                for text in part:
                    seen.update(text.lower().split())
                seen[END] += len(part)
                if len(seen) > FLUSH:
                    yield out()
        if seen:
            yield out()

    return train.select("t").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Types(dict):
    """word -> type; only the words of the table are kept."""

    def __init__(self, words: dict[bytes, int], endings: dict[bytes, int]):
        super().__init__(words)
        self.endings = endings

    def __missing__(self, word: bytes) -> int:
        return self.endings.get(word[-3:], OTHER_TYPE)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, back = np.unique(np.concatenate(keys), return_inverse=True)
    return at, np.bincount(back, weights=np.concatenate(counts), minlength=len(at)).astype(np.int64)


def count_keys(train: DataFrame, make: Callable[[], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """at, n: counts of the keys that make()(words of a text) gives for each training text, summed within tasks, with repeats between them.

    A task holds at most some FLUSH sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = make()
        keys, counts, held = [], [], 0
        out = lambda at, n: pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])
        for batch in batches:
            for part in slices(batch.column(0)):
                at, n = np.unique(np.concatenate([keyed(text.lower().split()) for text in part]), return_counts=True)
                keys.append(at)
                counts.append(n)
                held += len(at)
                if held > 4 * FLUSH:
                    keys, counts = ([x] for x in _merged(keys, counts))
                    held = len(keys[0])
                    if held > 2 * FLUSH:
                        yield out(keys[0], counts[0])
                        keys, counts, held = [], [], 0
        yield out(*_merged(keys, counts))

    return train.select("t").mapInArrow(run, "at long, n long")


def count_bigrams(train: DataFrame, types: Types, n_types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, n: counts of neighbouring types; each text begins after an end. At most n_types squared rows, whatever the corpus."""
    shared = train.sparkSession.sparkContext.broadcast((dict(types), types.endings))

    def make():
        own = Types(*shared.value)

        def keyed(words: list[bytes]) -> np.ndarray:
            line = np.empty(len(words) + 2, dtype=np.int64)
            line[0] = line[-1] = END_TYPE
            line[1:-1] = np.fromiter(map(own.__getitem__, words), dtype=np.int64, count=len(words))
            return line[:-1] * n_types + line[1:]

        return keyed

    got = count_keys(train, make).groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(at)
    return at[order] // n_types, at[order] % n_types, n[order].astype(float)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(x + 1e-300)


def _flow(a: np.ndarray, b: np.ndarray, n: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Counts of neighbouring classes."""
    return np.bincount(of[a] * k + of[b], weights=n, minlength=k * k).reshape(k, k)


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, n_types: int, classes: int = CLASSES, rounds: int = 6) -> np.ndarray:
    """A class for each type, from counts n of type b behind type a, each pair once. Type 0 is class 0 alone.

    One type at a time moves to the class of most mutual information, until few move. Of two starts the better end counts: types dealt to the classes in
    turn; and the most frequent types with a class each, the others waiting in one more, which all leave in order of frequency.
    """
    k = max(2, min(classes, n_types))
    order = np.lexsort((np.arange(1, n_types), -np.bincount(b, weights=n, minlength=n_types)[1:])) + 1
    dealt, waiting = np.zeros(n_types, dtype=np.int64), np.full(n_types, k, dtype=np.int64)
    dealt[order] = 1 + np.arange(n_types - 1) % (k - 1)
    waiting[np.append(0, order[: k - 1])] = np.arange(min(k, n_types))
    ends = [_exchanged(a, b, n, start, order, k, rounds) for start in (dealt, waiting)]

    def information(of: np.ndarray) -> float:
        table = _flow(a, b, n, of, k)
        return float(_h(table).sum() - _h(table.sum(0)).sum() - _h(table.sum(1)).sum())

    return max(ends, key=information)


def _exchanged(a: np.ndarray, b: np.ndarray, n: np.ndarray, of: np.ndarray, order: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """The classes after the moves from ``of``; class k is that of types that wait."""
    n_types = len(of)
    forth, back = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    at_a, at_b = np.searchsorted(a[forth], np.arange(n_types + 1)), np.searchsorted(b[back], np.arange(n_types + 1))
    behind, n_behind, ahead, n_ahead = b[forth], n[forth], a[back], n[back]
    loops = np.zeros(n_types)
    loops[a[a == b]] = n[a == b]
    table = _flow(a, b, n, of, k + 1)
    waits = bool((of == k).any())
    for turn in range(rounds):
        moved = 0
        for t in order:
            x, y = slice(at_a[t], at_a[t + 1]), slice(at_b[t], at_b[t + 1])
            out, into = np.bincount(of[behind[x]], weights=n_behind[x], minlength=k + 1), np.bincount(of[ahead[y]], weights=n_ahead[y], minlength=k + 1)
            c, self_ = of[t], loops[t]
            if not turn and waits and c < k:
                continue
            out[c] -= self_
            into[c] -= self_
            table[c, :] -= out
            table[:, c] -= into
            table[c, c] -= self_
            now = _h(table)
            gain = (_h(table + out[None, :]) - now).sum(1) + (_h(table + into[:, None]) - now).sum(0)
            d = np.diag(table)
            gain += _h(d + out + into + self_) + _h(d) - _h(d + out) - _h(d + into)
            rows, cols = table.sum(1) + into, table.sum(0) + out  # wherever it goes
            all_out, all_in = out.sum() + self_, into.sum() + self_
            gain -= _h(rows + all_out) - _h(rows) + _h(cols + all_in) - _h(cols)
            gain[0] = gain[k] = -np.inf
            best = int(np.argmax(gain))
            if c < k and gain[best] <= gain[c] + 1e-9 * max(1.0, abs(gain[c])):
                best = int(c)
            table[best, :] += out
            table[:, best] += into
            table[best, best] += self_
            if best != c:
                of[t] = best
                moved += 1
        if turn and moved <= n_types // 200:
            break
    return of


def gains(table: np.ndarray, word: np.ndarray, slot: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, and the class in which each gains most mutual information.

    word, slot, n: sorted by word; slot c: counts of class c before the word; slot k + c: behind it. table: the flow between classes without these words.
    """
    k = len(table)
    words, first = np.unique(word, return_index=True)
    if not len(words):
        return words, words
    side, other = slot // k, slot % k
    beside = np.where((side == 0)[:, None], table[other], table.T[other])  # flow between ``other`` and each class
    gain = np.add.reduceat(_h(beside + n[:, None]) - _h(beside), first, axis=0)
    row = np.repeat(np.arange(len(words)), np.diff(np.append(first, len(word))))
    into, out = np.zeros((len(words), k)), np.zeros((len(words), k))
    into[row[side == 0], other[side == 0]] = n[side == 0]
    out[row[side == 1], other[side == 1]] = n[side == 1]
    d = np.diag(table)[None, :]
    gain += _h(d + out + into) + _h(d) - _h(d + out) - _h(d + into)
    rows, cols = table.sum(1)[None, :] + into, table.sum(0)[None, :] + out
    gain -= _h(rows + out.sum(1, keepdims=True)) - _h(rows) + _h(cols + into.sum(1, keepdims=True)) - _h(cols)
    gain[:, 0] = -np.inf
    return words, np.argmax(gain, axis=1)


class Classes(dict):
    """word -> its number, or for words without one the number after all words plus the class of their ending."""

    def __init__(self, words: list[bytes], endings: dict[bytes, int], other: int):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.n, self.endings, self.other = len(words), endings, other

    def __missing__(self, word: bytes) -> int:
        return self.n + self.endings.get(word[-3:], self.other)


def place(train: DataFrame, shared, first: int, last: int, table: np.ndarray) -> list[tuple[int, int]]:
    """(number, class) of the known words from number ``first`` up to ``last``. shared: broadcast words, endings, other and classes so far."""
    k = len(table)

    def make():
        words, endings, other, classes = shared.value
        names, of = Classes(words, endings, other), np.concatenate([classes, np.arange(k)])

        def keyed(text: list[bytes]) -> np.ndarray:
            line = np.fromiter(map(names.__getitem__, text), dtype=np.int64, count=len(text))
            cls = of[line]
            own = np.flatnonzero((line >= first) & (line < last))
            before, behind = np.append(0, cls)[own], np.append(cls, 0)[own + 1]  # class 0: the end
            return np.concatenate([line[own] * (2 * k) + before, line[own] * (2 * k) + k + behind])

        return keyed

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            counts.append(batch.column(1).to_numpy())
            held += len(batch)
            if held > 4 * FLUSH:
                keys, counts = ([x] for x in _merged(keys, counts))
                held = len(keys[0]) // 2
        at, n = _merged(keys, counts)
        cuts = np.searchsorted(at, np.arange(at[0] // (2 * k), at[-1] // (2 * k) + 1) * (2 * k)) if len(at) else []
        cuts = [*np.unique(cuts).tolist(), len(at)]
        start = 0
        for stop in cuts[1:]:  # some words at a time
            if stop - start >= 8192 or stop == len(at):
                own = slice(start, stop)
                word, best = gains(table, at[own] // (2 * k), at[own] % (2 * k), n[own].astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(best.astype(np.int64))], names=["word", "class"])
                start = stop

    rows = count_keys(train, make).withColumn("word", F.floor(F.col("at") / (2 * k))).repartition("word").select("at", "n")
    got = rows.mapInArrow(placed, "word long, class long").toArrow()
    return list(zip(got.column("word").to_pylist(), got.column("class").to_pylist(), strict=True))


@dataclass
class Model:
    words: list[bytes]  # the most frequent
    counts: np.ndarray  # theirs
    classes: np.ndarray  # theirs
    endings: dict[bytes, int]  # classes of endings
    other: int  # the class of words of other endings
    transition: np.ndarray  # log10 P(class | previous class)
    emission: np.ndarray  # log10 of the denominator of P(word | class)
    base: float  # log10 of the base denominator
    total: int


def fit(train: DataFrame, counts: DataFrame, *, classes: int = CLASSES, type_words: int = TYPE_WORDS, type_endings: int = TYPE_ENDINGS, known_words: int = KNOWN_WORDS, least_count: int = LEAST_COUNT, least_exchanged: int = LEAST_EXCHANGED) -> Model:
    """A model from training texts (column t) and their written word counts. Without texts, every probability is that of a word never seen.

    The driver holds ``known_words`` words and at most (``type_words`` + ``type_endings``) squared counts, whatever the corpus.
    """
    spark = train.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.filter(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(known_words).toArrow()
    words, freq = [END, *top.column("word").to_pylist()], top.column("n").to_numpy().astype(np.float64)
    ends_n = counts.filter(F.length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    freq = np.append(float(ends_n), freq)
    often = 1 + int((freq[1:] >= least_count).sum())  # words are in order of frequency
    head = words[1 : min(type_words + 1, 1 + int((freq[1:] >= min(least_exchanged, least_count)).sum()))]
    types = {END: END_TYPE} | {w: i + 2 for i, w in enumerate(head)}
    shared_head = spark.createDataFrame([(bytearray(w),) for w in [END, *head]], "word binary")
    # The last three bytes, as in Types.
    ending = F.expr("substring(word, greatest(1, length(word) - 2), 3)")
    rest = counts.join(F.broadcast(shared_head), "word", "left_anti")
    ends = rest.groupBy(ending.alias("e")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "e").limit(type_endings).collect()
    endings = {bytes(r["e"]): i + 2 + len(head) for i, r in enumerate(ends)}
    n_types = 2 + len(head) + len(endings)
    a, b, n = count_bigrams(train, Types(types, endings), n_types)
    of = exchange(a, b, n, n_types, classes)
    k = int(of.max()) + 1
    endings, other = {e: int(of[t]) for e, t in endings.items()}, int(of[OTHER_TYPE])
    own = np.array([of[END_TYPE], *[endings.get(w[-3:], other) for w in words[1:]]], dtype=np.int64)
    own[1 : len(head) + 1] = of[2 : len(head) + 2]
    if often > len(head) + 1:
        sure = (np.maximum(a, b) < len(head) + 2) & (a != OTHER_TYPE) & (b != OTHER_TYPE)
        so_far = spark.sparkContext.broadcast((words, endings, other, own.copy()))
        for i, c in place(train, so_far, len(head) + 1, often, _flow(a[sure], b[sure], n[sure], of, k)):
            own[i] = c
    shared = spark.sparkContext.broadcast((words, endings, other, own))

    def make():
        w, e, o, c = shared.value
        names, classes_of = Classes(w, e, o), np.concatenate([c, np.arange(k)])

        def keyed(text: list[bytes]) -> np.ndarray:
            line = np.zeros(len(text) + 2, dtype=np.int64)
            line[1:-1] = classes_of[np.fromiter(map(names.__getitem__, text), dtype=np.int64, count=len(text))]
            return line[:-1] * k + line[1:]

        return keyed

    pairs = np.zeros(k * k)
    got = count_keys(train, make).groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    pairs[got.column("at").to_numpy()] = got.column("n").to_numpy()
    pairs = pairs.reshape(k, k)
    share = (pairs.sum(0) + 1) / (pairs.sum() + k)
    transition = np.log10((pairs + 20 * share[None, :]) / (pairs.sum(1, keepdims=True) + 20))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, e, o, c = shared.value
        names, classes_of = Classes(w, e, o), np.concatenate([c, np.arange(k)])
        sums = np.zeros((2, k), dtype=np.int64)
        for batch in batches:
            at = classes_of[np.fromiter(map(names.__getitem__, batch.column(0).to_pylist()), dtype=np.int64, count=len(batch))]
            sums += np.stack([np.bincount(at, weights=batch.column(1).to_numpy(), minlength=k), np.bincount(at, minlength=k)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(sums[0]), pa.array(sums[1])], names=["c", "n", "v"])

    sums = counts.select("word", "n").mapInArrow(classed, "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    tokens, kinds = np.zeros(k), np.zeros(k)
    for r in sums:
        tokens[r["c"]], kinds[r["c"]] = r["n"], r["v"]
    emission = np.log10(tokens + 0.5 * (kinds + 1))
    base = float(np.log10(total + 0.5 * (distinct + 1)))
    return Model(words, freq, own, endings, other, transition, emission, base, int(total))


def score(docs: DataFrame, model: Model, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n, k = len(m.words), len(m.emission)
        known = Classes(m.words, m.endings, m.other)
        of = np.concatenate([m.classes, np.arange(k)])
        value = np.concatenate([np.log10(m.counts + 0.5), np.zeros(k)])  # the rest of the words' part comes by the join
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column(0).slice(at, len(part)).to_pylist(), part, strict=True):
                    digest = xxhash.xxh64_intdigest(text) - (1 << 63)
                    rare: Counter = Counter()
                    before, tokens, words_part, score = 0, 0, 0.0, 0.0  # class 0: the end
                    for words in chain(parts_of(text), [[END]]):
                        line = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
                        cls = of[line]
                        own = value[line].sum()
                        words_part += own
                        score += own - m.emission[cls].sum() + m.transition[np.append(before, cls)[:-1], cls].sum()
                        tokens += len(line)
                        before = int(cls[-1]) if len(cls) else before
                        rare.update(words[i] for i in np.flatnonzero(line >= n).tolist())
                    # Where there is no training text, the end has not been seen.
                    unseen = int(m.counts[0] == 0)
                    rows.append((doc_id, digest, None, None, tokens, tokens - rare.total() - unseen, words_part - tokens * m.base, score, 1))
                    rows += [(doc_id, digest, w, c, 0, 0, 0.0, 0.0, 0) for w, c in rare.items()]
                at += len(part)
                cols = list(zip(*rows, strict=True)) or [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "digest", "word", "times", "n_tokens", "n_known", "base", "score", "docs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    parts = rows.mapInArrow(run, "doc_id long, digest long, word binary, times long, n_tokens long, n_known long, base double, score double, docs long")
    # A document's own row joins nothing; its key, which no word can be, deals these rows evenly.
    key = F.coalesce("word", F.concat(F.lit(" "), F.col("digest").cast("string")).cast("binary"))
    parts = parts.withColumn("word", key)
    n = F.coalesce(F.col("n"), F.lit(0))
    found = F.coalesce(F.col("times") * F.log10(n + 0.5), F.lit(0.0))
    joined = parts.join(counts.select("word", "n"), "word", "left").withColumn("found", found).withColumn("seen", F.when(n > 0, F.coalesce("times", F.lit(0))).otherwise(0))
    sums = joined.groupBy("doc_id", "digest").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "docs")], (F.sum("n_known") + F.sum("seen")).alias("n_known"), (F.sum("base") + F.sum("found")).alias("base"), (F.sum("score") + F.sum("found")).alias("score"))
    # Rows equal in id and text were summed together: each gets its share back.
    sums = sums.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("docs"))))
    share = lambda c: F.col(c) / F.col("docs")
    return sums.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("score").alias("score"),
    )


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """Fit on the documents outside the held-out fold and score all of them.

    Null texts count as empty and have one token, the end; null ids train like the empty id; repeated rows stay; an empty table gives no rows.
    """
    train = docs.filter(fold(F.col(id_col), FOLDS) != HELD_OUT).select(text_bytes(text_col).alias("t"))
    counts = materialize(count_words(train), "words")
    return score(docs, fit(train, counts, **sizes), counts, id_col=id_col, text_col=text_col)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity of the class model and of the base, by fold."""
    each = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(each("score").alias("perplexity"), each("base_score").alias("base_perplexity"))
