"""HTML extraction: the visible text of web pages, laid out as a reader sees it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, map_texts, quoted, table
from .html_tree import parse, render


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the visible text of each page as the column text (replacing one of that name).

    Keeps the spacing of blocks, list signs and numbers, and table cells in
    aligned columns. A null page has null text, an empty one empty text; broken
    markup always gives a tree, and nothing is cut. Rows are taken one by one, so
    repeated rows and an empty table need nothing special.
    """
    kept = [f for f in pages.schema.fields if f.name != text]
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept) + f", {quoted(text)} string"

    def work(part: pa.RecordBatch):
        texts = [None if x is None else render(*parse(x)) for x in part.column(html).to_pylist()]
        yield batch(**{f.name: part.column(f.name) for f in kept} | {text: pa.array(texts, pa.string())})

    return map_texts(pages, lambda: work, schema, html)


def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


QUERIES = {"op4_html_layout": op4_html_layout}
