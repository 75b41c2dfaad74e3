"""Chunkers: from (doc_id, text) to (chunk_id, doc_id, idx, content, section, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = r"(?U)^\s*$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _fold(parts: Column, full) -> Column:
    """Concatenate neighbours of an array; ``full`` (of the text so far) ends a chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        grown = F.concat(acc["now"], part)
        ends = full(grown)
        return F.struct(F.when(ends, F.array_append(acc["done"], grown)).otherwise(acc["done"]).alias("done"), F.when(ends, F.lit("")).otherwise(grown).alias("now"))

    return F.aggregate(parts, start, step, lambda a: F.when(F.length(a["now"]) > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"]))


def sentences_of(text: Column, size: int) -> Column:
    """Sentence pieces (cut behind 。；and line ends) put together until they reach ``size`` characters."""
    return _fold(F.regexp_extract_all(text, F.lit("(?s)[^。；\n]*[。；\n]|[^。；\n]+"), F.lit(0)), lambda t: F.char_length(t) >= size)


def packed_paragraphs(text: Column, size: int) -> Column:
    """Paragraphs packed greedily while the sum of their lengths stays within ``size``; a longer one goes by sentences.

    The separator between paragraphs is not counted.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("now"))

    def step(acc: Column, para: Column) -> Column:
        now, done = acc["now"], acc["done"]
        fits = F.char_length(now) + F.char_length(para) <= size
        closed = F.when(F.length(now) > 0, F.array_append(done, now)).otherwise(done)
        large = F.char_length(para) > size
        return F.struct(
            F.when(fits, done).when(large, F.concat(closed, sentences_of(para, size))).otherwise(closed).alias("done"),
            F.when(fits, F.concat(now, F.when(F.length(now) > 0, "\n\n").otherwise(""), para)).when(large, F.lit("")).otherwise(para).alias("now"),
        )

    paragraphs = F.filter(F.split(text, "\n\n"), lambda p: ~p.rlike(_BLANK))
    return F.aggregate(paragraphs, start, step, lambda a: F.when(F.length(a["now"]) > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"]))


def with_overlap(chunks: Column, overlap: int) -> Column:
    """Each chunk with the tail of the chunk before it; one that already stands in the output is left out."""
    if not overlap:
        return chunks
    numbered = F.transform(chunks, lambda c, i: F.struct(c.alias("c"), F.when(i > 0, F.right(F.get(chunks, i - 1), F.lit(overlap))).otherwise("").alias("tail"), (i == 0).alias("first")))
    start = F.array().cast("array<string>")
    return F.aggregate(numbered, start, lambda out, x: F.when(~x["first"] & F.array_contains(out, x["c"]), out).otherwise(F.array_append(out, F.concat(x["tail"], x["c"]))))


def _exploded(docs: DataFrame, chunks: Column, letter: str, kind: str | None, text_col: str, id_col: str) -> DataFrame:
    at = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunks).alias("idx", "content"))
    return at.select(F.concat(F.col("doc_id").cast("string"), F.lit(f"_{letter}"), F.col("idx").cast("string")).alias("chunk_id"), "doc_id", "idx", "content", F.lit(None).cast("string").alias("section"), F.lit(kind).cast("string").alias("kind"))


def recursive_chunks(docs: DataFrame, size: int = 400, overlap: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    # staged, so that the packed list is made once and not once for each use in the overlap
    packed = docs.select(id_col, packed_paragraphs(F.col(text_col), size).alias("packed"))
    return _exploded(packed, with_overlap(F.col("packed"), overlap), "c", None, text_col, id_col)


def legal_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections under title lines (第X章, 第X节, 第X编 or 一、); articles do not split them."""
    lines = F.filter(F.transform(F.split(text_col, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), _strip), lambda x: F.length(x) > 0)
    is_title = lambda s: s.rlike("^(第[一二三四五六七八九十百0-9]+[章节编]|[一二三四五六七八九十]+、)") & ~s.rlike("^第[一二三四五六七八九十百千0-9]+条")
    kind = "struct<done:array<struct<title:string,body:string>>,title:string,body:string>"
    start = F.from_json(F.lit('{"done":[],"title":"","body":""}'), kind)

    def flushed(acc: Column) -> Column:
        return F.when(F.length(acc["body"]) > 0, F.array_append(acc["done"], F.struct(acc["title"].alias("title"), acc["body"].alias("body")))).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        title = is_title(line)
        return F.struct(
            F.when(title, flushed(acc)).otherwise(acc["done"]).alias("done"),
            F.when(title, line).otherwise(acc["title"]).alias("title"),
            F.when(title, F.lit("")).otherwise(F.concat(acc["body"], F.when(F.length(acc["body"]) > 0, "\n").otherwise(""), line)).alias("body"),
        )

    sections = F.aggregate(lines, start, step, flushed)
    at = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sections).alias("idx", "s"))
    content = F.when(F.length("s.title") > 0, F.concat("s.title", F.lit("\n"), "s.body")).otherwise(F.col("s.body"))
    return at.select(F.concat(F.col("doc_id").cast("string"), F.lit("_l"), F.col("idx").cast("string")).alias("chunk_id"), "doc_id", "idx", content.alias("content"), F.col("s.title").alias("section"), F.lit("legal_clause").alias("kind"))


def table_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A chunk for each row that is not blank: first cell 为 the other cells."""

    def told(row: Column) -> Column:
        cells = F.filter(F.transform(F.split(row, "[,，\t]"), _strip), lambda c: F.length(c) > 0)
        return F.when(F.size(cells) >= 2, F.concat(F.get(cells, F.lit(0)), F.lit("为"), F.array_join(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1))), "，"))).otherwise(row)

    rows = F.filter(F.split(text_col, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), lambda r: ~r.rlike(_BLANK))
    return _exploded(docs, F.transform(rows, told), "f", "financial_table_row", text_col, id_col)
