"""Chunks of parsed content: its text, its tables row by row, its equations and its captions, numbered through a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import table_headers

#: Characters of a table's row, of an equation and of the text about it, and the mark of what was cut.
ROW_MOST, LATEX_MOST, AROUND_MOST, CUT = 4000, 2000, 1000, " …(截断)"
#: Tables of more rows repeat their headers, at each row of so many.
LONG_TABLE, WINDOW = 50, 20
#: What a chunk's id has before its number.
MARKS = {"table_row": "t", "equation": "eq", "image_caption": "img"}


def held(value: Column, body) -> Column:
    """body(value), with value worked out once for a row and not at each use inside it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(CUT))).otherwise(text)


def filled(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c")) != ""


def on_page(page: Column) -> Column:
    return F.when(page != 0, F.concat(F.lit("页 "), page.cast("string")))


def _table_rows(table: Column) -> Column:
    """Contents of a table's rows but its header and blank ones, each cell with its header."""
    rows, page = table["rows"], table["page"]
    header = F.when((table["header_row"] >= 0) & (table["header_row"] < F.size(rows)), table["header_row"]).otherwise(0)
    caption = F.when(F.coalesce(table["caption"], F.lit("")) == "", "未命名表").otherwise(table["caption"])

    def lines(head: Column) -> Column:
        numbered = F.transform(rows, lambda r, i: F.struct(i.alias("i"), F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))).alias("cells")))
        data = F.filter(numbered, lambda r: (r["i"] != head["at"]) & F.exists(r["cells"], filled))

        def content(row: Column, k: Column) -> Column:
            name = lambda j: F.coalesce(F.get(head["names"], j), F.concat(F.lit("col_"), j.cast("string")))
            pairs = F.filter(F.transform(row["cells"], lambda c, j: F.when(filled(c), F.concat(name(j), F.lit("="), c))), lambda p: p.isNotNull())
            again = F.when((k > 0) & (k % WINDOW == 0) & (F.size(rows) > LONG_TABLE), F.concat(F.lit("列: "), F.array_join(head["names"], " | ")))
            first = F.concat_ws(" · ", F.concat(F.lit("[表格] "), caption), on_page(page), F.concat(F.lit("第 "), row["i"].cast("string"), F.lit(" 行")), again)
            return cut(F.concat(first, F.lit("\n"), F.array_join(pairs, " | ")), ROW_MOST)

        return F.transform(data, content)

    names = table_headers(F.coalesce(F.get(rows, header), F.array().cast("array<string>")))
    return held(F.struct(header.alias("at"), names.alias("names")), lines)


def _equation(e: Column) -> Column:
    """An equation between its marks, under the text about it; null where it is blank."""
    around = F.coalesce(e["surrounding_text"], F.lit(""))
    inline = F.coalesce(e["inline"], F.lit(False))
    fence = F.when(inline, "$").otherwise("$$")
    about = F.when(around != "", F.regexp_replace(cut(around, AROUND_MOST), r"^\s+|\s+$", ""))
    text = F.concat_ws("\n", about, F.when(inline, "[公式·内联]").otherwise("[公式]"), F.concat(fence, cut(e["latex"], LATEX_MOST), fence), on_page(e["page"]))
    return F.when(filled(F.coalesce(e["latex"], F.lit(""))), text)


def _caption(image: Column) -> Column:
    """An image's caption with a hash for its address, so that no search shows where it is kept; null where it has none."""
    ref = F.when(image["uri"] != "", F.concat(F.lit("ref=minio:img_"), F.left(F.sha2(image["uri"], 256), F.lit(8))))
    return F.when(image["caption"] != "", F.concat_ws("\n", F.concat(F.lit("[图像] "), image["caption"]), on_page(image["page"]), ref))


def multimodal_chunks(docs: DataFrame, text_chunks: DataFrame | None = None) -> DataFrame:
    """doc_id, chunk_index, chunk_id, strategy, content: a document's text chunks, then its tables, equations and images.

    docs: doc_id (unique), tables (array of structs: rows, an array of arrays of strings; header_row, caption, page),
    equations (latex, inline, page, surrounding_text), images (uri, caption, page), each in its order. text_chunks: doc_id,
    chunk_index (from 0, gapless), chunk_id, strategy, content, cut by any strategy. Without it docs has them itself: texts,
    an array of structs (chunk_id, strategy, content) in order, and nothing is joined. Numbers go on from kind to kind.

    A header row that a table hasn't is its first. Blank rows, blank equations and images without a caption give nothing
    and take no number. Null cells are blank, null lists empty, a null page or page 0 isn't named, and null ids are left
    out. Blocks are made where a document is read; with text_chunks ids, contents and the numbers of text chunks are joined.
    """
    none = F.array().cast("array<string>")
    listed = lambda name, one: F.filter(F.transform(F.coalesce(F.col(name), F.array().cast(docs.schema[name].dataType)), one), lambda x: x.isNotNull())
    kinds = {"table_row": F.coalesce(F.flatten(listed("tables", _table_rows)), none), "equation": listed("equations", _equation), "image_caption": listed("images", _caption)}

    def of_kind(kind: str, contents: Column) -> Column:
        return F.transform(contents, lambda x: F.struct(F.lit(kind).alias("strategy"), x.alias("content")))

    blocks = F.concat(*[of_kind(k, c) for k, c in kinds.items()])
    columns = ["doc_id", "chunk_index", "chunk_id", "strategy", "content"]
    mark = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    number = F.when(F.col("chunk_index") > 9999, F.col("chunk_index").cast("string")).otherwise(F.lpad(F.col("chunk_index").cast("string"), 4, "0"))
    id = F.concat(F.col("doc_id").cast("string"), F.lit("_"), mark[F.col("strategy")], number)
    if text_chunks is None:
        texts = F.transform(F.coalesce("texts", F.array().cast(docs.schema["texts"].dataType)), lambda x: F.struct(x["strategy"].alias("strategy"), x["content"].alias("content"), x["chunk_id"].alias("chunk_id")))
        others = F.transform(blocks, lambda x: F.struct(x["strategy"].alias("strategy"), x["content"].alias("content"), F.lit(None).cast("string").alias("chunk_id")))
        rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.concat(texts, others)).alias("chunk_index", "block"))
        rows = rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "block.*")
        return rows.withColumn("chunk_id", F.coalesce("chunk_id", id)).select(columns)
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(blocks).alias("pos", "block"))
    before = text_chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    index = (F.coalesce("n", F.lit(0)) + F.col("pos")).cast("long")
    rows = rows.join(before, "doc_id", "left").select("doc_id", index.alias("chunk_index"), "block.strategy", "block.content")
    rows = rows.withColumn("chunk_id", id)
    return text_chunks.where(F.col("doc_id").isNotNull()).select(columns).unionByName(rows.select(columns))
