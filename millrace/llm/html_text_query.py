"""Query of main-text extraction over the whole `pages` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import html_text
from millrace.llm.common import table


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


QUERIES = {"op2_html_extraction": op2_html_extraction}
