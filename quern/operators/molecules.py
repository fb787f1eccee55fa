"""Molecules as arrays of atoms with their bonds: fragments, charges, order-free keys, circular fingerprints and simple descriptors.

A molecule is one row whatever its table's size, and its atoms are as many as its string has, so all that looks at neighbours works inside the row with array
functions; only strings are shuffled, to find the distinct ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import smiles
from quern.sources import tables

ATOMS = "array<struct<element:string,isotope:int,charge:int,h:int,aromatic:boolean,part:int,near:array<struct<to:int,order:int,ring:int,bond:int>>>>"
#: The elements that a standardised molecule may hold.
ALLOWED = ("H", "C", "N", "O", "P", "S", "F", "Cl", "Br", "I")

_NEAR = pa.list_(pa.struct([(n, pa.int32()) for n in ("to", "order", "ring", "bond")]))
_ATOM = pa.struct([("element", pa.string()), ("isotope", pa.int32()), ("charge", pa.int32()), ("h", pa.int32()), ("aromatic", pa.bool_()), ("part", pa.int32()), ("near", _NEAR)])


def parsed(rows: DataFrame, id_col: str, col: str) -> DataFrame:
    """``id, reason, atoms`` of each row: the atoms of the molecule string in ``col``, or why it is none (``parse_failed``; null and blank strings too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons, found = [], []
            for text in batch.column("text").to_pylist():
                try:
                    atoms, _ = smiles.molecule((text or "").strip())
                    keys = ("element", "isotope", "charge", "h", "aromatic", "part")
                    found.append([dict(zip(keys, a)) | {"near": [dict(zip(("to", "order", "ring", "bond"), e)) for e in a[6]]} for a in atoms])
                    reasons.append(None)
                except smiles.Unreadable:
                    found.append(None), reasons.append("parse_failed")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(reasons, pa.string()), pa.array(found, pa.list_(_ATOM))], names=["id", "reason", "atoms"])

    some = rows.select(F.col(id_col).alias("id"), F.col(col).cast("string").alias("text"))
    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, reason string, atoms {ATOMS}")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value worked out once: inside a lambda a column's expression would be worked out again for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def _of(values: Column, i: Column) -> Column:
    return F.get(values, i)


def heavy(atoms: Column) -> Column:
    return F.size(F.filter(atoms, lambda a: a["element"] != "H"))


def weight(atoms: Column) -> Column:
    """Sum of standard atomic weights, hydrogens included."""
    table = F.create_map(*[F.lit(x) for pair in smiles.WEIGHTS.items() for x in pair])
    return F.aggregate(atoms, F.lit(0.0), lambda s, a: s + F.element_at(table, a["element"]) + a["h"] * F.lit(smiles.WEIGHTS["H"]))


def formula(atoms: Column) -> Column:
    """Elements with their numbers: carbon and hydrogen first where there is carbon, the others by name."""

    def written(all_: Column) -> Column:
        organic = F.array_contains(all_, F.lit("C"))
        place = lambda e: F.when(organic & (e == "C"), F.lit("0")).when(organic & (e == "H"), F.lit("1")).otherwise(e)
        names = F.array_sort(F.transform(F.array_distinct(all_), lambda e: F.struct(place(e).alias("p"), e.alias("e"), F.size(F.filter(all_, lambda x: x == e)).alias("n"))))
        return F.array_join(F.transform(names, lambda s: F.concat(s["e"], F.when(s["n"] > 1, s["n"].cast("string")).otherwise(""))), "")

    return _let(F.concat(F.transform(atoms, lambda a: a["element"]), F.flatten(F.transform(atoms, lambda a: F.array_repeat(F.lit("H"), a["h"])))), written)


def first_labels(atoms: Column) -> Column:
    """What an atom is on its own: element, isotope, charge, hydrogens, aromaticity, number of bonds and the smallest ring it lies in."""
    ring = lambda a: F.coalesce(F.array_min(F.transform(F.filter(a["near"], lambda e: e["ring"] > 0), lambda e: e["ring"])), F.lit(0))
    return F.transform(atoms, lambda a: F.xxhash64(a["element"], a["isotope"], a["charge"], a["h"], a["aromatic"], F.size(a["near"]), ring(a)))


def _next(atoms: Column, labels: Column) -> Column:
    """One step further out: an atom's label with those of its neighbours and the bonds that lead there, in an order of their own. Both are bound."""
    around = lambda a: F.sort_array(F.transform(a["near"], lambda e: F.xxhash64(e["order"], e["ring"], _of(labels, e["to"]))))
    return F.transform(atoms, lambda a, i: F.xxhash64(_of(labels, i), around(a)))


def next_labels(atoms: Column, labels: Column) -> Column:
    return _let(atoms, lambda a: _let(labels, lambda m: _next(a, m)))


def key(atoms: Column) -> Column:
    """A 64-bit key that does not depend on the order of atoms: labels refined as many times as there are atoms, sorted and hashed with the bonds' number.

    Refinement tells all but a few highly regular graphs apart; ring sizes in the labels tell the usual ones of those."""

    def of(a: Column) -> Column:
        labels = F.aggregate(F.sequence(F.lit(1), F.size(a)), first_labels(a), lambda s, _: _next(a, s))
        return F.xxhash64(F.sort_array(labels), F.aggregate(a, F.lit(0), lambda s, x: s + F.size(x["near"])))

    return _let(atoms, of)


def largest_part(atoms: Column) -> Column:
    """The atoms of the part between dots with most heavy atoms, then the greatest weight, then the first; salts and solvents go. A ring bond may join
    parts; then all stay."""

    def of(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.array_max(F.transform(a, lambda x: x["part"]))), lambda p: F.struct(F.filter(a, lambda x: x["part"] == p).alias("own"), p.alias("p")))
        best = F.array_max(F.transform(parts, lambda x: F.struct(heavy(x["own"]).alias("heavy"), weight(x["own"]).alias("weight"), (-x["p"]).alias("first"))))
        joined = F.exists(a, lambda x: F.exists(x["near"], lambda e: _of(a, e["to"])["part"] != x["part"]))
        kept = _let(F.struct(best.alias("best"), joined.alias("joined")), lambda c: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: c["joined"] | (_of(a, i)["part"] == -c["best"]["first"])))
        placed = lambda k, e: e.withField("to", (F.array_position(k, e["to"]) - 1).cast("int"))
        one = lambda k, x: x.withField("near", F.transform(x["near"], lambda e: placed(k, e)))
        return _let(kept, lambda k: F.transform(k, lambda i: one(k, _of(a, i))))

    return _let(atoms, of)


def neutral(atoms: Column) -> Column:
    """Charges go where a hydrogen can be taken or given: ammonium loses one, carboxylate gets one. A charge next to the opposite one (nitro groups, N-oxides) stays, a quaternary nitrogen
    stays, and so do as many negative atoms as it takes to balance such ones, those with the least labels."""

    def of(a: Column) -> Column:
        met = lambda x, sign: F.exists(x["near"], lambda e: _of(a, e["to"])["charge"] * sign > 0)
        gives = lambda x: (x["charge"] > 0) & (x["h"] >= x["charge"]) & ~met(x, -1)
        takes = lambda x: (x["charge"] < 0) & ~met(x, 1) & (x["element"] != "H")
        fixed = F.aggregate(a, F.lit(0), lambda s, x: s + F.when((x["charge"] > 0) & ~gives(x) & ~met(x, -1), x["charge"]).otherwise(0))
        listed = F.transform(F.arrays_zip(a.alias("x"), first_labels(a).alias("label"), F.sequence(F.lit(0), F.size(a) - 1).alias("i")), lambda z: F.when(takes(z["x"]), F.struct(z["label"].alias("label"), z["i"].alias("i"))))
        order = F.sort_array(F.filter(listed, lambda z: z.isNotNull()))
        chosen = _let(F.struct(order.alias("order"), fixed.alias("fixed")), lambda c: F.transform(F.slice(c["order"], c["fixed"] + 1, F.size(c["order"]) + 1), lambda z: z["i"]))

        def one(x: Column, i: Column, c: Column) -> Column:
            change = F.when(gives(x) | F.array_contains(c, i), x["charge"]).otherwise(0)
            return x.withField("charge", x["charge"] - change).withField("h", x["h"] - change)

        return _let(chosen, lambda c: F.transform(a, lambda x, i: one(x, i, c)))

    charged = F.exists(atoms, lambda x: x["charge"] != 0)
    return F.when(charged, _let(atoms, of)).otherwise(atoms)


def standardised(rows: DataFrame, id_col: str, col: str) -> DataFrame:
    """``id, valid, reason, atoms, key, formula, weight, n_heavy_atoms, charge`` of the molecule strings in ``col``.

    The largest part, uncharged where hydrogens allow it. Equal molecules have equal keys however they are written (order of atoms, ring numbers, aromatic or alternating bonds, hydrogens
    written or not); stereo marks are read over and tautomers are not unified. A string that is no molecule gives ``parse_failed``, one without an atom
    but hydrogen ``all_atoms_stripped``, one with other elements than :data:`ALLOWED` ``disallowed_atoms:...``; null and blank strings are ``parse_failed``; those rows stay, with nulls.

    Each distinct string is read and worked out once and written; rows get what their string gives by a join.
    """
    some = rows.select(F.col(id_col).alias("id"), F.col(col).cast("string").alias("_text"))
    made = tables.written(_standardised(some.select("_text").distinct(), "_text", "_text").withColumnRenamed("id", "_string"), "molecules")
    return some.join(made, F.col("_text").eqNullSafe(F.col("_string"))).drop("_text", "_string")


def _standardised(rows: DataFrame, id_col: str, col: str) -> DataFrame:
    """:func:`standardised` of rows as they are."""
    part = largest_part(F.col("atoms"))
    made = _let(part, lambda a: F.when(heavy(a) > 0, neutral(a)))
    out = parsed(rows, id_col, col).select("id", "reason", F.when(F.col("reason").isNull(), made).alias("_a"))

    def read(a: Column) -> Column:
        other = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(a, lambda x: x["element"]), lambda e: ~e.isin(*ALLOWED)))), ",")
        values = {"key": key(a), "formula": formula(a), "weight": weight(a), "n_heavy_atoms": heavy(a), "charge": F.aggregate(a, F.lit(0), lambda s, x: s + x["charge"])}
        return F.struct(other.alias("other"), a.alias("atoms"), *[c.alias(n) for n, c in values.items()])

    out = out.select("id", "reason", F.when(F.col("_a").isNotNull(), _let(F.col("_a"), read)).alias("m"))
    reason = F.coalesce("reason", F.when(F.col("m").isNull(), "all_atoms_stripped"), F.when(F.col("m.other") != "", F.concat(F.lit("disallowed_atoms:"), F.col("m.other"))))
    live = reason.isNull()
    return out.select("id", live.alias("valid"), reason.alias("reason"), *[F.when(live, F.col(f"m.{n}")).alias(n) for n in ("atoms", "key", "formula", "weight", "n_heavy_atoms", "charge")])


def _further(atoms: Column, bonds: Column) -> Column:
    """The bonds within one more step of each atom. Both are bound."""
    return F.transform(atoms, lambda a: F.sort_array(F.array_distinct(F.flatten(F.transform(a["near"], lambda e: F.array_append(_of(bonds, e["to"]), e["bond"]))))))


def circular_bits(molecules: DataFrame, atoms: str = "atoms", n_bits: int = 1024, radius: int = 2, out_col: str = "bits") -> DataFrame:
    """``molecules`` with the set bits (ascending) of a circular fingerprint: a label for each atom and each distance up to ``radius`` bonds, folded to ``n_bits``.

    Of labels that cover the same bonds one counts, that of the least distance, then the least. Bits are of this library's own hash, so they compare with each other and not
    with a toolkit's. Rows without atoms (failed ones) have null.
    """

    def steps(a: Column, labels: Column, bonds: Column, r: int, found: Column) -> Column:
        """The labels of one more step added to ``found``, and so on; all are bound."""
        if r > radius:
            return found
        add = lambda m, b: F.concat(found, F.filter(F.transform(F.arrays_zip(b.alias("e"), m.alias("l")), lambda z: F.struct(z["e"].alias("e"), F.lit(r).alias("r"), z["l"].alias("l"))), lambda z: F.size(z["e"]) > 0))
        return _let(_next(a, labels), lambda m: _let(_further(a, bonds), lambda b: _let(add(m, b), lambda f: steps(a, m, b, r + 1, f))))

    def folded(a: Column) -> Column:
        none = F.array().cast("array<struct<e:array<int>,r:int,l:bigint>>")
        alone = F.transform(a, lambda _: F.array().cast("array<int>"))
        first = _let(F.sort_array(_let(first_labels(a), lambda m: _let(alone, lambda b: steps(a, m, b, 1, none)))), lambda f: F.filter(f, lambda x, i: (i == 0) | (_of(f, i - 1)["e"] != x["e"])))
        labels = F.concat(first_labels(a), F.transform(first, lambda x: x["l"]))  # sorted by bonds, distance, label
        return F.sort_array(F.array_distinct(F.transform(labels, lambda x: F.pmod(x, F.lit(n_bits)).cast("int"))))

    return molecules.withColumn(out_col, F.when(F.col(atoms).isNotNull(), _let(F.col(atoms), folded)))


def words(bits: Column, n_bits: int = 1024) -> Column:
    """The set bits as ``n_bits / 64`` 64-bit words, as the bit operations and Tanimoto distances take them."""
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b.bitwiseAND(F.lit(63)))
    own = lambda v, k: F.aggregate(F.filter(v, lambda b: F.shiftright(b, 6) == k), F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(bit(b)))
    return F.when(bits.isNotNull(), _let(bits, lambda v: F.transform(F.sequence(F.lit(0), F.lit(n_bits // 64 - 1)), lambda k: own(v, k))))


def descriptors(atoms: Column) -> Column:
    """Numbers of a molecule, as a struct: weight, heavy atoms, bonds, rings, hydrogen donors and acceptors (N and O with and without hydrogens), single bonds between two
    non-terminal atoms outside of rings (rotatable), aromatic atoms, carbons with four neighbours as a share of carbons, charge."""

    def read(a: Column) -> Column:
        big = lambda x: F.size(F.filter(x["near"], lambda e: _of(a, e["to"])["element"] != "H"))
        each = lambda f: F.aggregate(a, F.lit(0), lambda s, x: s + f(x).cast("int"))
        turning = lambda x: F.size(F.filter(x["near"], lambda e: (e["order"] == 1) & (e["ring"] == 0) & (big(x) > 1) & (big(_of(a, e["to"])) > 1)))
        bonds, carbon = (each(lambda x: F.size(x["near"])) / 2).cast("int"), each(lambda x: x["element"] == "C")
        full = each(lambda x: (x["element"] == "C") & ~x["aromatic"] & ~F.exists(x["near"], lambda e: e["order"] > 1))
        polar = lambda x: x["element"].isin("N", "O")
        values = {
            "weight": weight(a), "n_heavy": heavy(a), "n_bonds": bonds, "n_rings": bonds - F.size(a) + 1,
            "donors": each(lambda x: polar(x) & (x["h"] > 0)), "acceptors": each(polar), "rotatable": (each(turning) / 2).cast("int"), "aromatic": each(lambda x: x["aromatic"]),
            "share_sp3": F.when(carbon > 0, full / carbon).otherwise(0.0), "charge": each(lambda x: x["charge"]),
        }
        return F.struct(*[c.alias(n) for n, c in values.items()])

    return F.when(atoms.isNotNull(), _let(atoms, read))
