"""Parsed documents, a tree of pages, blocks, lines and spans, as rows of images and text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions.text import file_name, first_filled, first_full, stripped

# Least length of a text chunk, and lengths of slices of captions and of texts.
LEAST, CAPTION, SLICE = 5, 50, 50

_LINES = "array<struct<spans:array<struct<type:string,content:string,image_path:string>>>>"
_BLOCK = f"struct<type:string,bbox:array<double>,blocks:array<struct<lines:{_LINES}>>,lines:{_LINES},text:string,text_content:string>"
_PAGE = f"struct<preproc_blocks:array<{_BLOCK}>,middle_blocks:array<{_BLOCK}>>"
PARSED = f"pdf_info array<{_PAGE}>, pdf_intermediate_dict array<{_PAGE}>"


def _spans(lines: Column) -> Column:
    return F.flatten(F.transform(F.filter(lines, lambda x: x["spans"].isNotNull()), lambda x: x["spans"]))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.coalesce(s["content"], F.lit(""))), "")


def blocks(parsed: DataFrame) -> DataFrame:
    """(asset, page_idx, block_idx, type, bbox, caption, image, text) for each block of each page.

    ``parsed`` has asset and the columns of ``PARSED``. Of two page or block lists the first that isn't empty counts.
    An image or table block's caption is the text of its inner spans, its image the last path among them.
    """
    pages = parsed.select("asset", F.posexplode(first_full(F.col("pdf_info"), F.col("pdf_intermediate_dict"))).alias("page_idx", "page"))
    each = pages.select("asset", "page_idx", F.posexplode(first_full(F.col("page.preproc_blocks"), F.col("page.middle_blocks"))).alias("block_idx", "b"))
    inner = _spans(F.flatten(F.transform(F.filter(F.col("b.blocks"), lambda x: x["lines"].isNotNull()), lambda x: x["lines"])))
    own = _spans(F.col("b.lines"))
    paths = F.filter(F.transform(inner, lambda s: s["image_path"]), lambda p: p != "")
    spoken = F.coalesce(_said(own), F.lit(""))
    return each.select(
        "asset", "page_idx", "block_idx", F.col("b.type").alias("type"), F.col("b.bbox").alias("bbox"),
        F.coalesce(_said(inner), F.lit("")).alias("caption"), F.try_element_at(paths, F.lit(-1)).alias("image"),
        first_filled(spoken, F.col("b.text"), F.col("b.text_content")).alias("text"),
    )


def images(found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(asset, name, page_idx, text_slice, bbox, place) of image and table blocks; a name that comes again replaces.

    With ``files`` (asset, name, length) only images that exist and aren't empty stay. The place is where the name
    first came.
    """
    own = found.filter(F.col("type").isin("image", "table") & F.col("image").isNotNull()).withColumn("name", file_name(F.col("image")))
    order = F.struct("page_idx", "block_idx")
    row = F.struct("page_idx", F.substring("caption", 1, CAPTION).alias("text_slice"), "bbox")
    last = own.groupBy("asset", "name").agg(F.max_by(row, order).alias("row"), F.min(order).alias("place")).select("asset", "name", "row.*", "place")
    return last.join(files.filter("length > 0").select("asset", "name"), ["asset", "name"], "left_semi") if files is not None else last


def chunks(found: DataFrame) -> DataFrame:
    """(asset, page_idx, block_idx, text, text_slice, bbox) of text blocks with enough text once stripped."""
    own = found.filter(~F.coalesce(F.col("type").isin("image", "table"), F.lit(False))).withColumn("text", stripped(F.col("text")))
    return own.filter(F.length("text") >= LEAST).select("asset", "page_idx", "block_idx", "text", F.substring("text", 1, SLICE).alias("text_slice"), "bbox")


def lines_as_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A plain text's lines as blocks: (id, block_idx, text, text_slice) of those with enough text once stripped."""
    each = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("block_idx", "line")).withColumn("text", stripped(F.col("line")))
    return each.filter(F.length("text") >= LEAST).select(id_col, "block_idx", "text", F.substring("text", 1, SLICE).alias("text_slice"))
