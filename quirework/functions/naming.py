"""Slugs, file names and output names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P
from .expr import let
from .text import py_strip


def or_default(c: Column, default) -> Column:
    """``c``, or the default where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def slugify(c: Column) -> Column:
    """Lower-case words joined by single dashes; ``book`` when nothing is left."""
    kept = F.regexp_replace(F.lower(py_strip(c)), rf"[^{P.WORD}{P.SPACE}\-]+", "")
    dashed = F.regexp_replace(kept, rf"[{P.SPACE}_\-]+", "-")
    return or_default(F.trim(dashed, F.lit("-")), "book")


def book_slug(title: Column, author: Column, stem: Column) -> Column:
    def part(c):
        return F.when(F.coalesce(c, F.lit("")) != "", slugify(c))

    joined = F.concat_ws("__", part(author), part(title))
    return or_default(joined, F.coalesce(part(stem), F.lit("book")))


def _path_parts(path: Column) -> Column:
    """The path with one kind of separator and none at its end."""
    return F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))


def file_stem_of(path: Column) -> Column:
    """Last path part without its extension; both kinds of slash separate parts."""
    name = F.substring_index(_path_parts(path), "/", -1)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+\z", "$1")


def slug_from_path(path: Column) -> Column:
    """Book slug behind the path of an interior file."""

    def pick(stem):
        tail = F.substring_index(_path_parts(path), "/", -2)
        parent = F.when(F.contains(tail, F.lit("/")), F.substring_index(tail, "/", 1)).otherwise("")
        return (
            F.when(stem.endswith("__interior"), F.regexp_replace(stem, r"__interior\z", ""))
            .when(stem == "interior", or_default(F.regexp_replace(parent, r"_output\z", ""), "book"))
            .otherwise(slugify(stem))
        )

    return let(file_stem_of(path), pick)


# --- output names (fixed values: the formats) -------------------------------------


def output_dir(slug: Column) -> Column:
    return F.concat(slug, F.lit("_output"))


def interior_name(slug: Column) -> Column:
    return F.concat(slug, F.lit("__interior.pdf"))


def editable_name(slug: Column) -> Column:
    return F.concat(slug, F.lit("__editable.docx"))


def markdown_name(slug: Column) -> Column:
    return F.concat(slug, F.lit("__google-docs.md"))


def imposed_name(slug: Column, sheets: Column, pages: Column) -> Column:
    return F.concat(
        slug, F.lit("__imposed__"), sheets.cast("string"), F.lit("sheets__"),
        pages.cast("string"), F.lit("pages.pdf"),
    )


def imposed_default_name(stem: Column, pages: Column, direction: Column) -> Column:
    label = F.when(direction == "rtl", F.lit("RTL")).otherwise(F.lit("LTR"))
    return F.concat(
        stem, F.lit(" - Imposed "), pages.cast("string"), F.lit("pp "), label, F.lit(".pdf")
    )


# --- safe file names, three dialects ----------------------------------------------


def _one_space(c: Column, by: str) -> Column:
    return F.regexp_replace(c, rf"[{P.SPACE}]+", by)


def safe_component(c: Column) -> Column:
    """Illegal characters deleted, spaces collapsed, blanks and dots trimmed."""
    kept = F.regexp_replace(py_strip(F.coalesce(c, F.lit(""))), rf"[{P.ILLEGAL_FILE_CHARS}]+", "")
    return or_default(F.trim(_one_space(kept, " "), F.lit(" .")), "Unknown")


def safe_download_name(c: Column, limit: int = 180) -> Column:
    """Illegal and control characters become underscores; the name is cut."""
    spaced = py_strip(_one_space(c, " "))
    marked = F.regexp_replace(spaced, rf"[{P.ILLEGAL_FILE_CHARS}\x00-\x1f]", "_")
    return or_default(F.substring(marked, 1, limit), P.DEFAULT_WORK_FILE)


def safe_underscored(c: Column) -> Column:
    """Spaces, illegal and control characters become underscores."""
    spaced = _one_space(py_strip(c), "_")
    return or_default(F.regexp_replace(spaced, rf"[{P.ILLEGAL_FILE_CHARS}\x00-\x1f]", "_"), "book")
