"""Sources and sinks: JSON bodies, page tables, reports. A1, A4, A14, A17."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions.text import escape_html, escape_markdown

MAX_BODY = 5 * 1024 * 1024
RENDERED = (
    "page_id bigint, url string, html string, text string, final_url string, title string, hidden_spans array<struct<text:string,reason:string,path:string>>, "
    "meta struct<meta:map<string,string>,lang:string,canonical:string>, isolated boolean, strip_incomplete boolean, http_status int, retrieval_status string"
)


def read_json_bodies(spark: SparkSession, path: str, most: int = MAX_BODY) -> DataFrame:
    """A4: (path, body, too_large): whole files; the body of one over the bound is null."""
    rows = spark.read.format("binaryFile").load(path)
    ok = F.col("length") <= most
    return rows.select("path", F.when(ok, F.decode("content", "UTF-8")).alias("body"), (~ok).alias("too_large"))


def read_rendered(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A1: rendered pages, as the schema RENDERED has them; column pruning reaches the scan."""
    return spark.read.format(kind).schema(RENDERED).load(path)


def write_html_report(rows: DataFrame, path: str, columns: list[str], title: str = "report") -> None:
    """An HTML table, one line a row, active characters escaped; head and foot are lines of their own."""
    line = lambda tag, cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>"))
    body = rows.select(line("td", [escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("value"))
    one = rows.sparkSession.range(1, numPartitions=1)
    head = one.select(F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), escape_html(F.lit(title)), F.lit("</title><table>"), line("th", [escape_html(F.lit(c)) for c in columns])).alias("value"))
    head.unionAll(body).unionAll(one.select(F.lit("</table>").alias("value"))).write.mode("overwrite").text(path)


def write_markdown_report(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A Markdown table, active characters escaped; one line a row."""
    cells = [escape_markdown(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)
