"""Molecule strings, as far as their text alone tells: fragments, atoms, charges. A chemistry toolkit plugs in at ``sources.boundaries``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An atom, a hydrogen in brackets, a charged atom of those that may stand without brackets, and all that a string may hold.
ATOM = r"\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops]"
HYDROGEN = r"^\[\d*H[+-]?\d*\]$"
CHARGED = r"\[([BCNOPS])(?:H\d*)?[+-]\d*\]"
ALLOWED = r"^[A-Za-z0-9@+\-\[\]()=#$:/\\.%*]+$"


def heavy_atoms(c: Column) -> Column:
    """Number of atoms but hydrogen."""
    return F.size(F.filter(F.regexp_extract_all(c, F.lit(ATOM), F.lit(0)), lambda x: ~F.regexp_like(x, F.lit(HYDROGEN))))


def largest_fragment(c: Column) -> Column:
    """Of the parts between dots the one with most heavy atoms, then the longest, then the first: salts and solvents go."""
    parts = F.transform(F.split(c, r"\."), lambda x, i: F.struct(heavy_atoms(x).alias("atoms"), F.length(x).alias("n"), (-i).alias("place"), x.alias("part")))
    return F.array_max(parts)["part"]


def uncharged(c: Column) -> Column:
    """Charged atoms that may stand without brackets lose their charge."""
    return F.regexp_replace(c, CHARGED, "$1")


def standardised(c: Column) -> Column:
    """struct<valid, reason, canonical, atoms>: the uncharged largest fragment, or why there is none (empty, characters, unbalanced, no heavy atom)."""
    s = F.trim(c)
    count = lambda sign: F.length(s) - F.length(F.replace(s, F.lit(sign), F.lit("")))
    reason = (
        F.when(s.isNull() | (s == ""), "empty").when(~F.regexp_like(s, F.lit(ALLOWED)), "characters")
        .when((count("(") != count(")")) | (count("[") != count("]")), "unbalanced").when(heavy_atoms(s) == 0, "no heavy atom")
    )
    made = F.when(reason.isNull(), uncharged(largest_fragment(s)))
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"), made.alias("canonical"), heavy_atoms(made).alias("atoms"))
