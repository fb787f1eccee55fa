"""Citations in the GB/T 7714 style and links to their articles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import MISSING, doi_of


def present(c: Column) -> Column:
    """Trimmed; missing-value words are ''."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(MISSING), "").otherwise(t)


def part(c: Column) -> Column:
    """Present, without trailing punctuation."""
    return F.regexp_replace(present(c), r"[ .,;:]+$", "")


def author_list(authors: Column) -> Column:
    """Up to three authors, then ', et al'."""
    names = F.filter(F.transform(authors, part), lambda a: a != "")
    return F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, ", et al").otherwise(""))


def gbt7714(authors: Column, title: Column, filename: Column, journal: Column, year: Column, volume: Column, issue: Column, pages: Column, doi: Column) -> Column:
    """One line: authors, title[J], journal, year, volume(issue): pages, DOI; absent parts leave no trace."""
    who = author_list(authors)
    name = F.coalesce(F.nullif(part(title), F.lit("")), F.nullif(part(filename), F.lit("")), F.lit("Untitled"))
    add = lambda before, c, after="": F.when(c != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    line = F.concat(
        add("", who, ". "), name, F.lit("[J]"), add(". ", part(journal)), add(", ", present(year)), add(", ", present(volume)),
        add("(", present(issue), ")"), add(": ", present(pages)), F.lit("."), add(" DOI: ", doi_of(present(doi)), "."),
    )
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def article_url(doi: Column, pubmed: Column) -> Column:
    """Link by DOI, else by PubMed id, else NULL."""
    d, p = doi_of(doi), F.regexp_extract(F.coalesce(pubmed, F.lit("")), r"^\s*(\d+)\s*$", 1)
    return F.when(d != "", F.concat(F.lit("https://doi.org/"), d)).when(p != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), p, F.lit("/")))
