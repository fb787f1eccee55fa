"""Paths, stable identifiers and file-name grammar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Old root folders and their places now, first match by order, then anchors that a path of another machine is cut at.
MOVED = (("old_sweet/", "library/sweetness/"), ("old_dual/", "library/dual_protein/"))
ANCHORS = ("library/", "old_sweet/", "old_dual/", "data/")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, "[^/]*$", 0)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(basename(c), r"(?<=.)(\.[^.]*)$", 1))


def moved(c: Column, rules: Sequence[tuple[str, str]] = MOVED) -> Column:
    """From the first old root that the path contains, the new root and what follows it."""
    out = F.when(F.lit(False), c)
    for old, new in rules:
        out = out.when(F.instr(c, old) > 0, F.concat(F.lit(new), F.substr(c, F.instr(c, old) + len(old))))
    return out.otherwise(c)


def canonical(c: Column, base: str, rules: Sequence[tuple[str, str]] = MOVED, anchors: Sequence[str] = ANCHORS) -> Column:
    """Forward slashes; relative paths and those under ``base`` as they are, others from the first known anchor, else the name alone; then moved roots."""
    p = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    root = base.rstrip("/") + "/"
    out = F.when(~p.startswith("/"), moved(p, rules)).when(p.startswith(root), moved(F.substr(p, F.lit(len(root) + 1)), rules))
    for a in anchors:
        out = out.when(F.instr(p, a) > 0, moved(F.substr(p, F.instr(p, a)), rules))
    return out.otherwise(basename(p))


def document_id(path: Column) -> Column:
    """24 hex digits of the SHA-256 of the path ('unknown' for none)."""
    return F.substring(F.sha2(F.coalesce(F.nullif(path, F.lit("")), F.lit("unknown")), 256), 1, 24)


def chunk_id(document: Column, text: Column) -> Column:
    """24 hex digits of the SHA-256 of the document id and the text with collapsed white space."""
    from quern.functions.text import collapse_space

    return F.substring(F.sha2(F.concat(document, F.lit(":"), collapse_space(text)), 256), 1, 24)


NAME = r"^(.+?)\s*(?:等|et al\.?|and others)?\s*-\s*(\d{4})\s*-\s*(.+)$"


def from_name(c: Column) -> Column:
    """struct(author, year, title) of names like 'Author et al - Year - Title.pdf'; NULL for others."""
    s = stem(c)
    part = lambda k: F.trim(F.regexp_extract(s, NAME, k))
    return F.when(F.regexp_like(s, F.lit(NAME)), F.struct(part(1).alias("author"), part(2).alias("year"), part(3).alias("title")))


def without_copy_mark(c: Column) -> Column:
    """A stem without a trailing '(1)', 'copy' or its Chinese word."""
    return F.trim(F.regexp_replace(c, r"(?i)[\s_-]*(?:\(\d+\)|copy|副本)$", ""))
