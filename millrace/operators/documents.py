"""Document structuring: pages, blocks, tables, feeds and totals from nested payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import block_markdown, clean_table_text

OCR_PAYLOAD = """documentId STRING, pages ARRAY<STRUCT<pageIndex: INT, markdown: STRUCT<text: STRING>,
 sourceBlocks: ARRAY<STRUCT<blockId: STRING, blockLabel: STRING, blockContent: STRING, blockBbox: ARRAY<DOUBLE>>>,
 pageHeight: DOUBLE, pageWidth: DOUBLE>>, extractionMetadata STRUCT<extractionTimeSeconds: DOUBLE, logId: STRING, timestamp: STRING, fileType: STRING>"""
CHUNK_PAYLOAD = """id STRING, fileId STRING, status STRING, metrics STRUCT<pageCount: INT, processingTimeMs: BIGINT>,
 chunks ARRAY<STRUCT<type: STRING, content: STRING, metadata: STRUCT<pageRange: STRUCT<start: INT, `end`: INT>>>>"""


def parse_ocr(rows: DataFrame, json: str = "payload") -> DataFrame:
    return rows.withColumn("doc", F.from_json(json, OCR_PAYLOAD))


def parse_chunks(rows: DataFrame, json: str = "payload") -> DataFrame:
    return rows.withColumn("doc", F.from_json(json, CHUNK_PAYLOAD))


def page_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per page: number (its index, or its place if the index is 0 or missing), text, blocks, size; a document
    without pages has one row without a place."""
    p = docs.select(id_col, F.posexplode_outer("doc.pages").alias("pos", "page"))
    index = F.coalesce(F.nullif(F.col("page.pageIndex"), F.lit(0)), F.col("pos"))
    return p.select(id_col, "pos", index.alias("page_index"), F.coalesce("page.pageIndex", F.lit(0)).alias("feed_index"), F.coalesce("page.markdown.text", F.lit("")).alias("text"), F.col("page.sourceBlocks").alias("blocks"), "page.pageHeight", "page.pageWidth")


def block_rows(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per block, with its page and place; a page without blocks has one row without a place."""
    b = pages.select(id_col, F.col("pos").alias("page_pos"), "page_index", "feed_index", F.posexplode_outer("blocks").alias("block_pos", "block"))
    return b.select(id_col, "page_pos", "page_index", "feed_index", "block_pos", F.col("block.blockId").alias("block_id"), F.lower(F.coalesce("block.blockLabel", F.lit(""))).alias("label"), F.coalesce("block.blockContent", F.lit("")).alias("content"))


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def tables(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks labelled table that are not blank, numbered through the document."""
    w = Window.partitionBy(id_col).orderBy("page_pos", "block_pos")
    kept = blocks.filter((F.lower("label") == "table") & ~is_blank(F.col("content")))
    return kept.withColumn("table_no", F.row_number().over(w)).withColumn("content", clean_table_text(F.col("content")))


def feed(blocks: DataFrame, id_col: str = "doc_id", blocked: bool = False) -> DataFrame:
    """The text of a document for a model: each non-blank block in the markdown of its label, an empty line behind it;
    with marks: a line for each page, also one without blocks, and for each block.  With marks, a document without pages
    has an empty feed."""
    kept = blocks.filter(~is_blank(F.col("content"))) if not blocked else blocks
    text = block_markdown(F.trim("content"), F.col("label"))
    lines = F.concat(text, F.lit("\n"))
    if blocked:
        mark = F.concat(F.lit("[BLOCK: "), F.coalesce("block_id", F.lit("")), F.lit("]\n\n"))
        lines = F.when(is_blank(F.col("content")), F.lit(None)).otherwise(F.concat(mark, lines))
    ordered = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("block_pos", "line"))))
    per = kept.withColumn("line", lines).groupBy(id_col, "page_pos", "feed_index").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("body"), F.count("line").alias("kept"))
    if blocked:
        head = F.concat(F.lit("=== PAGE "), F.col("feed_index") + 1, F.lit(" ===\n"))
        per = per.withColumn("body", F.when(F.col("kept") > 0, F.concat(head, F.lit("\n"), F.col("body"))).when(F.col("page_pos").isNotNull(), head))
    return per.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_pos", "body"))), lambda s: s["body"]), "\n").alias("feed"))


def document_text(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Page texts in order, a blank line between."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return pages.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n").alias("text"))


def document_totals(pages: DataFrame, blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pages, tables and text length of each document."""
    p = pages.groupBy(id_col).agg(F.count("pos").alias("n_pages"), F.sum(F.length("text")).alias("text_length"))
    t = tables(blocks, id_col).groupBy(id_col).agg(F.count("*").alias("n_tables"))
    return p.join(t, id_col, "left").withColumn("n_tables", F.coalesce("n_tables", F.lit(0)))


def route_chunks(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per chunk: its kind (page, table, other) and page number: range start, else end, else pages so far plus one."""
    c = docs.select(id_col, F.posexplode("doc.chunks").alias("pos", "chunk"))
    kind = F.when(F.col("chunk.type") == "page", "page").when(F.col("chunk.type") == "table", "table").otherwise("other")
    w = Window.partitionBy(id_col, "kind").orderBy("pos")
    rows = c.select(id_col, "pos", kind.alias("kind"), F.col("chunk.content").alias("content"), F.col("chunk.metadata.pageRange.start").alias("s"), F.col("chunk.metadata.pageRange.end").alias("e"))
    number = F.coalesce(F.nullif(F.col("s"), F.lit(0)), F.nullif(F.col("e"), F.lit(0)), F.row_number().over(w))
    return rows.select(id_col, "pos", "kind", "content", F.when(F.col("kind") == "page", number).alias("page_no"))


def placeholder_pages(docs: DataFrame, id_col: str, count: str) -> DataFrame:
    """Empty pages for documents that have a page count only."""
    return docs.filter(F.col(count) > 0).select(id_col, F.explode(F.sequence(F.lit(1), F.col(count))).alias("page_no"), F.lit("").alias("text"))


def unified(ocr: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One extraction record per document from either payload: pages, tables and text."""
    op = page_rows(ocr, id_col)
    a = document_text(op, id_col).join(document_totals(op, block_rows(op, id_col), id_col), id_col).select(id_col, F.lit("blocks").alias("origin"), "text", "n_pages", "n_tables")
    routed = route_chunks(chunks, id_col)
    pages = routed.filter("kind = 'page'")
    text = pages.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda s: s["content"]), "\n\n").alias("text"), F.count("*").alias("n_pages"))
    n_tables = routed.filter("kind = 'table'").groupBy(id_col).agg(F.count("*").alias("n_tables"))
    b = text.join(n_tables, id_col, "left").select(id_col, F.lit("chunks").alias("origin"), "text", "n_pages", F.coalesce("n_tables", F.lit(0)).alias("n_tables"))
    return a.unionByName(b)


def extraction_metadata(docs: DataFrame, totals: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Metadata of an extraction, filled from the totals where the payload has none."""
    meta = docs.select(id_col, F.col("doc.extractionMetadata").alias("m"))
    return meta.join(totals, id_col, "left").select(id_col, F.coalesce("m.extractionTimeSeconds", F.lit(0.0)).alias("seconds"), F.coalesce("m.fileType", F.lit("pdf")).alias("file_type"), "n_pages", "n_tables", "text_length")
