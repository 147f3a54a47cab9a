"""Rendering of table grids (``array<array<string>>``, first row = header)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docpipe.functions.scalars import rstrip_text

TABLE_FORMATS = ("markdown", "html", "code", "csv")


def _body(grid: Column) -> Column:
    return F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0)))


def _header(grid: Column) -> Column:
    return F.coalesce(F.get(grid, F.lit(0)), F.array().cast("array<string>"))


def _has_rows(grid: Column, rendered: Column) -> Column:
    return F.when(F.coalesce(F.size(grid), F.lit(0)) > 0, rendered).otherwise(F.lit(""))


def table_markdown(grid: Column) -> Column:
    """Pipe table; body rows are padded or cut to the width of the header."""
    width = F.size(_header(grid))

    def line(row: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(row, " | ", ""), F.lit(" |"))

    def fitted(row: Column) -> Column:
        padding = F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))
        return F.slice(F.concat(row, padding), F.lit(1), width)

    rule = line(F.array_repeat(F.lit("---"), width))
    lines = F.concat(
        F.array(line(_header(grid)), rule), F.transform(_body(grid), lambda row: line(fitted(row)))
    )
    return F.when(F.coalesce(width, F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def table_html(grid: Column) -> Column:
    """``thead`` from the first row, ``tbody`` only if more rows follow."""

    def cells(row: Column, tag: str) -> Column:
        return F.transform(
            row,
            lambda cell: F.concat(
                F.lit(f"      <{tag}>"), F.coalesce(cell, F.lit("")), F.lit(f"</{tag}>")
            ),
        )

    def fixed(*lines: str) -> Column:
        return F.array(*[F.lit(line) for line in lines])

    def html_row(row: Column) -> Column:
        return F.concat(fixed("    <tr>"), cells(row, "td"), fixed("    </tr>"))

    head = F.concat(
        fixed("<table>", "  <thead>", "    <tr>"), cells(_header(grid), "th"),
        fixed("    </tr>", "  </thead>"),
    )
    body = F.concat(
        fixed("  <tbody>"), F.flatten(F.transform(_body(grid), html_row)), fixed("  </tbody>")
    )
    no_body = F.array().cast("array<string>")
    lines = F.concat(head, F.when(F.size(grid) > 1, body).otherwise(no_body), fixed("</table>"))
    return _has_rows(grid, F.array_join(lines, "\n"))


def table_code(grid: Column) -> Column:
    """Tab-separated rows in a code fence."""
    rows = F.transform(grid, lambda row: F.array_join(row, "\t", ""))
    fence = F.array(F.lit("```"))
    return _has_rows(grid, F.array_join(F.concat(fence, rows, fence), "\n"))


def table_csv(grid: Column) -> Column:
    """CSV with minimal quoting and CRLF, right-stripped at the end."""

    def field(cell: Column) -> Column:
        text = F.coalesce(cell, F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)

    def record(row: Column) -> Column:
        lone_blank = (F.size(row) == 1) & (F.coalesce(F.get(row, F.lit(0)), F.lit("")) == "")
        return F.when(lone_blank, F.lit('""')).otherwise(F.array_join(F.transform(row, field), ","))

    return _has_rows(grid, rstrip_text(F.array_join(F.transform(grid, record), "\r\n")))


RENDERERS = {
    "markdown": table_markdown,
    "html": table_html,
    "code": table_code,
    "csv": table_csv,
}


def render_table(grid: Column, fmt: str) -> Column:
    if fmt not in RENDERERS:
        raise ValueError(f"Unsupported table format: {fmt}")
    return RENDERERS[fmt](grid)


def render_page_tables(tables: Column, fmt: str = "markdown") -> Column:
    """All tables of a page, each followed by a blank line; empty ones skipped."""
    kept = F.filter(tables, lambda t: F.size(t.data) > 0)
    parts = F.flatten(F.transform(kept, lambda t: F.array(render_table(t.data, fmt), F.lit(""))))
    return F.coalesce(F.array_join(parts, "\n"), F.lit(""))
