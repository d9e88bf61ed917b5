"""Markup columns: noise removal, table rows to markdown, media links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrag.functions.rules import safe_path_id
from corrag.functions.text import let

# --- Fixed values -------------------------------------------------------------------------
ZERO_WIDTH = "[\u200b\u200c\u200d\ufeff]"
ANNOTATION_ELEMENT = r"(?is)<annotation(\s[^>]*)?>.*?</annotation\s*>"
HTML_BASE = "https://arxiv.org/html/"
# -----------------------------------------------------------------------------------------


def clean_markup(html: Column) -> Column:
    """Drop zero-width characters and raw-TeX annotations; rendered glyphs stay."""
    return F.regexp_replace(F.regexp_replace(html, ZERO_WIDTH, ""), ANNOTATION_ELEMENT, "")


def _markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def rows_to_markdown(rows: Column) -> Column:
    """``array<array<string>>`` to a pipe table; ``""`` without rows or header cells."""
    clean = F.transform(rows, lambda row: F.transform(row, lambda cell: F.replace(
        F.regexp_replace(cell, r"\s+", " "), F.lit("|"), F.lit("\\|"))))

    def table(grid: Column) -> Column:
        header = F.get(grid, F.lit(0))
        body = F.filter(F.slice(grid, F.lit(2), F.size(grid) - 1), lambda row: F.size(row) > 0)
        fitted = F.transform(body, lambda row: _markdown_row(F.slice(
            F.concat(row, F.array_repeat(F.lit(""), F.size(header))), F.lit(1), F.size(header))))
        rule = _markdown_row(F.array_repeat(F.lit("---"), F.size(header)))
        return F.array_join(F.concat(F.array(_markdown_row(header), rule), fitted), "\n")

    header_cells = F.size(F.get(rows, F.lit(0)))
    return F.when(F.coalesce(header_cells, F.lit(0)) <= 0, F.lit("")).otherwise(let(clean, table))


def _without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path that starts with a slash."""
    kept = F.aggregate(
        F.split(path, "/", -1), F.array().cast("array<string>"),
        lambda acc, part: F.when(part == "..", F.slice(
            acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(part == ".", acc).otherwise(F.concat(acc, F.array(part))))
    return F.array_join(kept, "/")


def resolve_media_url(src: Column, paper_id: Column, base: str = HTML_BASE) -> Column:
    """Absolute link for an image, kept only under the paper's own directory."""
    origin, base_path = base[: base.index("/", 8)], base[base.index("/", 8):]
    relative = F.concat(F.lit(origin), _without_dot_segments(
        F.when(F.startswith(src, F.lit("/")), src).otherwise(F.concat(F.lit(base_path), src))))
    url = (F.when(src.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), src)
           .when(F.startswith(src, F.lit("//")), F.concat(F.lit("https:"), src))
           .otherwise(relative))
    own = F.concat(F.lit(base), safe_path_id(paper_id))
    return F.when((src != "") & F.startswith(url, own), url)
