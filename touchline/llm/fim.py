"""Fill-in-middle: texts cut at two drawn places and put together with the middle last.

A text is UTF-8 bytes and is never an array of characters. Counting its units notes the byte and the code-point offset of every ``EVERY``-th unit; a cut
is found by bisecting these checkpoints and reading on over fewer than ``EVERY`` units. Units are code points, or the stretches that a pattern's matches end.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and so many of 100 transformed ones have the suffix first.
RATE, SPM = 90, 20
#: Units between checkpoints; bytes of a text that are counted at one time.
EVERY, BLOCK = 1024, 1 << 18


def code_points(data: bytes) -> int:
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


class Checkpoints:
    """Where every ``every``-th unit of a text begins: its number, byte and code point. ``units`` and ``chars`` are the totals."""

    def __init__(self, data: bytes, every: int = EVERY, unit: re.Pattern[bytes] | None = None):
        self.data, self.every, self.unit = data, every, unit
        self.at, self.bytes, self.chars_at = array("q", [0]), array("q", [0]), array("q", [0])
        self.units, self.chars = self._by_pattern() if unit else self._by_code_points()

    def _by_code_points(self) -> tuple[int, int]:
        seen = 0
        for start in range(0, len(self.data), BLOCK):
            heads = np.flatnonzero((np.frombuffer(self.data, np.uint8, min(BLOCK, len(self.data) - start), start) & 0xC0) != 0x80)
            first = -seen % self.every or (0 if seen else self.every)  # the next multiple, in this block; the first of all is noted already
            for i in range(first, len(heads), self.every):
                self._note(seen + i, start + int(heads[i]), seen + i)
            seen += len(heads)
        return seen, seen

    def _by_pattern(self) -> tuple[int, int]:
        """Units end where matches end; what follows the last match is a unit, too."""
        units = chars = begin = 0
        for m in self.unit.finditer(self.data):
            if m.end() == begin:
                continue
            chars += code_points(self.data[begin : m.end()])
            units, begin = units + 1, m.end()
            if units % self.every == 0:
                self._note(units, begin, chars)
        if begin < len(self.data):
            units, chars = units + 1, chars + code_points(self.data[begin:])
        return units, chars

    def _note(self, unit: int, byte: int, char: int) -> None:
        self.at.append(unit)
        self.bytes.append(byte)
        self.chars_at.append(char)

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset behind the first ``unit`` units."""
        i = bisect_right(self.at, unit) - 1
        left, at, char = unit - self.at[i], self.bytes[i], self.chars_at[i]
        if not left:
            return at, char
        if unit >= self.units:
            return len(self.data), self.chars
        if self.unit is None:
            stretch = np.frombuffer(self.data, np.uint8, min(4 * left + 4, len(self.data) - at), at)  # four bytes a code point at most
            return at + int(np.flatnonzero((stretch & 0xC0) != 0x80)[left]), char + left
        begin = at
        for m in self.unit.finditer(self.data, at):
            if m.end() > begin:
                begin, left = m.end(), left - 1
                if not left:
                    break
        return begin, char + code_points(self.data[at:begin])


def draws(doc_id: str, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 of the seed and id."""
    hexed = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(hexed[i : i + 8], 16) for i in range(0, 32, 8))


def transformed(data: bytes, doc_id: str, *, seed: int = 1, rate: int = RATE, spm: int = SPM, every: int = EVERY, unit: re.Pattern[bytes] | None = None) -> tuple:
    """n, form, prefix_chars, middle_chars and output (bytes) of one text."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    marks, (h1, h2, h3, h4) = Checkpoints(data, every, unit), draws(doc_id, seed)
    n = marks.units
    if not data or p in data or s in data or m in data or h3 % 100 >= rate:
        return n, "plain", None, None, data
    (a, prefix), (b, both) = (marks.cut(x) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < spm:
        return n, "spm", prefix, both - prefix, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return n, "psm", prefix, both - prefix, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = RATE, spm: int = SPM, every: int = EVERY, unit: bytes | None = None) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every row.

    A null text is empty and stays plain, as do texts that hold one of the marks; a null id draws as the empty text; rows of one id and text come out
    alike; an empty table gives no rows. unit: a pattern over UTF-8 bytes whose matches end units, code points if null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit) if unit else None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            at = 0
            for part in slices(batch.column(2)):
                ids, names = (batch.column(i).slice(at, len(part)).to_pylist() for i in (0, 1))
                rows = [(i, *transformed(t, name, seed=seed, rate=rate, spm=spm, every=every, unit=pattern)) for i, name, t in zip(ids, names, part, strict=True)]
                at += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = F.col(id_col)
    rows = docs.select(own.cast("long"), F.coalesce(own.cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    out = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output and its form were made of. A mark begins with a character that it has nowhere else, so a cut can't make one."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
