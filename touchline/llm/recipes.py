"""Exact duplicates by recipes of content-defined chunks, with DataFrame functions only.

1. A text without its white space is cut into chunks where its own bytes say so: behind neighbouring characters whose last bytes leave REMAINDERS, one after the
   other, so that every script is cut; from LEAST bytes on, and at MOST at the latest.
2. Chunks become identifiers: a 64-bit hash, verified over the whole corpus. Each distinct chunk is moved once from each task that has it; where different
   chunks share a hash, their order tells them apart.
3. A document is its recipe, the ordered list of its chunks' identifiers. Equal recipes are equal texts. Only recipes are grouped and joined: a
   long document moves as eight bytes for some KB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import join_hot, materialize

SPACE = r"[\x20\x09-\x0D]+"
#: There is a cut behind neighbouring characters whose last bytes in UTF-8 leave these remainders by four: one place in 256 where they are spread evenly.
MODULUS, REMAINDERS = 4, (1, 2, 0, 3)
#: Bytes of a chunk.
LEAST, MOST = 256, 8192
#: Bits of the hash that names a chunk; fewer only in tests.
BITS = 64


def ending(remainder: int) -> str:
    """A pattern of a character whose last byte leaves the remainder, over UTF-8 bytes as Latin-1 characters."""
    last = "".join(f"\\x{b:02X}" for b in range(0xC0) if b % MODULUS == remainder)
    return rf"(?:[\xC0-\xFF][\x80-\xBF]{{0,2}})?[{last}]"


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """Lazily from ``least`` bytes on up to a cut, else ``most`` bytes or the rest."""
    n = len(REMAINDERS)
    return rf"(?s).{{{least - n},{most - 4 * n}}}?{''.join(ending(r) for r in REMAINDERS)}(?![\x80-\xBF])|.{{1,{most}}}"


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, "")


def chunks(text: Column | str, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order, as Latin-1 strings of its UTF-8 bytes; an empty text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(chunk_pattern(least, most)), F.lit(0))


def name(chunk: Column | str, bits: int = BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits) if bits < 64 else F.xxhash64(chunk)


def ambiguous(cut: DataFrame, bits: int = BITS) -> DataFrame | None:
    """name, chunk, other of chunks whose name another chunk has, too (other: from 0 in order of content); none if every name is one chunk's.

    cut: a column of that name with arrays of chunks. Distinct chunks are found with partial aggregation, so a chunk that a third of the texts hold is one row a task.
    """
    store = cut.select(F.explode(F.array_distinct("cut")).alias("chunk")).distinct()
    names = materialize(store.groupBy(name("chunk", bits).alias("name")).agg(F.count("*").alias("n")).filter("n > 1").select("name"), "ambiguous")
    if names.isEmpty():
        return None
    same = store.withColumn("name", name("chunk", bits)).join(names, "name", "left_semi")
    return same.withColumn("other", F.row_number().over(Window.partitionBy("name").orderBy("chunk")) - 1)


def with_recipes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """row (a number), doc_id, n_chars, text_sha256, recipe (array of name and other), key (its hash) of every row, written: narrow, whatever the texts' length."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"), normalised(text_col).alias("plain"))
    found = ambiguous(rows.select(chunks("plain", least, most).alias("cut")), bits)
    cut = rows.withColumn("cut", chunks("plain", least, most)).withColumn("text_sha256", F.sha2(F.col("plain").cast("binary"), 256))
    named = lambda c: F.struct(name(c, bits).alias("name"), F.lit(0).alias("other"))
    narrow = ["row", "doc_id", "n_chars", "text_sha256"]
    cut = cut.withColumn("row", F.monotonically_increasing_id())
    if found is None:
        return keyed(cut.select(*narrow, F.transform("cut", named).alias("recipe")))
    # Names that tell too little: the chunks themselves are looked up, and lists put together again by row. Of any input a few, as names have 64 bits.
    cut = materialize(cut.select(*narrow, "cut"), "chunks")
    found = materialize(found.select("chunk", "other"), "others")
    each = cut.select("row", F.posexplode("cut").alias("at", "chunk")).join(found, "chunk", "left")
    item = F.struct("at", name("chunk", bits).alias("name"), F.coalesce("other", F.lit(0)).alias("other"))
    lists = each.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("l"))  # of one document
    lists = lists.select("row", F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["other"].alias("other"))).alias("recipe"))
    out = cut.drop("cut").join(lists, "row", "left")
    return keyed(out.withColumn("recipe", F.coalesce("recipe", F.array().cast(lists.schema["recipe"].dataType))))


def keyed(recipes: DataFrame) -> DataFrame:
    return materialize(recipes.withColumn("key", F.xxhash64("recipe")), "recipes")


def groups(recipes: DataFrame) -> DataFrame:
    """row, doc_id, text_sha256, keep_id, keep_row, group_size of every row of with_recipes().

    Of equal recipes the row of the most code points stays, then of the smallest id, null ids last, then the first read.
    """
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    known = recipes.groupBy("key", "recipe").agg(F.min(order).alias("k"), F.count("*").alias("size"))
    # Joined by a hash of the recipe; the recipes that share it (one, as good as always) stand in one list.
    facts = known.groupBy("key").agg(F.collect_list(F.struct("recipe", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), "size")).alias("facts"))
    out = join_hot(recipes, facts, "key")
    own = F.filter("facts", lambda x: x["recipe"] == F.col("recipe"))[0]
    out = out.withColumn("own", own)
    return out.select("row", "doc_id", "text_sha256", "own.keep_id", "own.keep_row", F.col("own.size").alias("group_size"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. Texts that differ in white space only are equal.

    Null texts are empty; all texts without anything but white space are one group; repeated rows and ids are rows of their own, of which one stays;
    a group of null ids has a null keep_id; an empty table gives no rows.
    """
    out = groups(with_recipes(docs, id_col=id_col, text_col=text_col, **options))
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
