"""A static HTML report of small result tables."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

#: Rows of a table that the report shows.
ROWS = 5_000


def payload(shown: dict[str, list[dict]]) -> str:
    """The tables as JSON that is safe within a page."""
    return json.dumps(shown, default=str).replace("<", "\\u003c")


def page(title: str, tables: dict[str, DataFrame]) -> str:
    """Tables of up to ``ROWS`` rows; of longer ones the first rows, which the page says. The same rows are in it as JSON."""
    parts, shown = [], {}
    for name, table in tables.items():
        rows = table.limit(ROWS + 1).collect()
        note = f"<p>The first {ROWS} rows; the table has more.</p>" if len(rows) > ROWS else ""
        rows = rows[:ROWS]
        shown[name] = [r.asDict() for r in rows]
        head = "".join(f"<th>{html.escape(c)}</th>" for c in table.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2>{note}<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}<script type='application/json' id='tables'>{payload(shown)}</script></body></html>"


def write_report(path: str, title: str, tables: dict[str, DataFrame]) -> None:
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(page(title, tables),)], "value string").coalesce(1).write.mode("overwrite").text(path)
