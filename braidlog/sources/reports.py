"""Report sinks: ranked patterns as HTML, tables as CSV."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame


def top_html(scored: DataFrame, path: str, k: int = 20) -> None:
    """The ``k`` first rows of a ranking as an HTML table."""
    rows = scored.limit(k).collect()  # ``k`` rows
    cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in scored.columns)
    body = "".join(f"<tr>{''.join(cell('td', x) for x in r)}</tr>\n" for r in rows)
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"<!DOCTYPE html><meta charset='utf-8'><table><tr>{head}</tr>\n{body}</table>\n")


def csv(table: DataFrame, path: str) -> None:
    """Any report table (timings, metrics, run statistics, situations) as CSV with a header."""
    table.write.mode("overwrite").option("header", True).csv(path)


def csv_by(table: DataFrame, path: str, key: str) -> None:
    """A report table of several configurations as one folder of CSV files for each value of ``key``."""
    table.write.mode("overwrite").partitionBy(key).option("header", True).csv(path)
