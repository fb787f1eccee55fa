"""Molecule strings: equal molecules in different spellings, charges, failures, and fingerprints against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import smiles
from quern.operators import molecules

#: Spellings of one molecule each, its formula and its charge.
SAME = [
    (["OCC", "CCO", "C(O)C", "[CH3][CH2][OH]", "[H]OC([H])([H])C", "C-C-O", "CCO.[Na+].[Cl-]"], "C2H6O", 0),
    (["c1ccccc1", "C1=CC=CC=C1", "C=1C=CC=CC1", "c1cc(ccc1)[H]"], "C6H6", 0),
    (["C[N+](=O)[O-]", "[O-][N+](C)=O", "O=[N+]([O-])C"], "CH3NO2", 0),
    (["C[N+](C)(C)C", "[N+](C)(C)(C)C", "C[N+](C)(C)C.[Br-]"], "C4H12N", 1),
    (["CC(=O)[O-].[Na+]", "CC(=O)O", "OC(C)=O", "CC([O-])=O"], "C2H4O2", 0),
    (["C[NH3+].[Cl-]", "CN", "NC"], "CH5N", 0),
    (["C[N+](C)(C)CC(=O)[O-]", "[O-]C(=O)C[N+](C)(C)C"], "C5H11NO2", 0),
    (["[NH3+]CC(=O)[O-]", "NCC(=O)O", "OC(=O)CN"], "C2H5NO2", 0),
    (["c1cc[nH]c1", "C1=CNC=C1", "[nH]1cccc1"], "C4H5N", 0),
    (["c1ccc2ccccc2c1", "C1=CC2=CC=CC=C2C=C1", "c1ccc2c(c1)cccc2"], "C10H8", 0),
    (["O=c1cccc[nH]1", "O=C1C=CC=CN1"], "C5H5NO", 0),
    (["c1ccccc1c1ccccc1", "c1ccccc1-c2ccccc2", "c1ccc(cc1)-c1ccccc1"], "C12H10", 0),
    (["F[C@H](Cl)Br", "F[C@@H](Cl)Br", "ClC(Br)F"], "CHBrClF", 0),
    (["C1CC1.O", "C%10CC%10"], "C3H6", 0),
    (["CS(=O)(=O)C", "O=S(=O)(C)C"], "C2H6O2S", 0),
    (["[13CH4]"], "CH4", 0),
    (["C1CCC2CCCCC2C1"], "C10H18", 0),
    (["C1CCC(C1)C1CCCC1"], "C10H18", 0),
    (["C1CCCCC1"], "C6H12", 0),
    (["OCCC"], "C3H8O", 0), (["CC(O)C"], "C3H8O", 0), (["CCOC", "COCC"], "C3H8O", 0),
    (["C1=CC=CC=CC=C1"], "C8H8", 0), (["C1=CCC=C1", "C1C=CC=C1"], "C5H6", 0), (["C#N", "N#C"], "CHN", 0), (["n1ccccc1", "C1=CC=NC=C1"], "C5H5N", 0),
]
BAD = {"": "parse_failed", "  ": "parse_failed", "C1CC(": "parse_failed", "C)C": "parse_failed", "C1CC": "parse_failed", "not one!": "parse_failed", "C(C)(C)(C)(C)C": "parse_failed", "[Xx]": "parse_failed", "cc": "parse_failed", "C11": "parse_failed",
       "[H+]": "all_atoms_stripped", "[H][H]": "all_atoms_stripped", "[Na+]": "disallowed_atoms:Na", "C[Si](C)(C)C": "disallowed_atoms:Si", "C[As]([Pt])C": "disallowed_atoms:As,Pt"}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{i}/{k}", s) for i, (spellings, *_) in enumerate(SAME) for k, s in enumerate(spellings)] + [(f"bad {s}", s) for s in BAD] + [("null", None)]
    df = molecules.standardised(spark.createDataFrame(rows, "name string, smiles string").repartition(3), "name", "smiles")
    return {r["id"]: r for r in molecules.circular_bits(df).withColumn("words", molecules.words(F.col("bits"))).collect()}


def test_spellings_of_one_molecule_agree(found):
    keys = []
    for i, (spellings, formula, charge) in enumerate(SAME):
        rows = [found[f"{i}/{k}"] for k in range(len(spellings))]
        assert [r["reason"] for r in rows] == [None] * len(rows), spellings
        assert {r["formula"] for r in rows} == {formula} and {r["charge"] for r in rows} == {charge}, spellings
        assert len({r["key"] for r in rows}) == 1 and len({tuple(r["bits"]) for r in rows}) == 1, spellings
        keys.append(rows[0]["key"])
    assert len(set(keys)) == len(SAME)


def test_failed_rows_are_listed(found):
    assert {s: found[f"bad {s}"]["reason"] for s in BAD} == BAD and found["null"]["reason"] == "parse_failed"
    assert all(r["atoms"] is None and r["key"] is None and r["bits"] is None and not r["valid"] for i, r in found.items() if i.startswith("bad") or i == "null")


def environments(atoms, radius):
    """The bond sets within a radius, and a molecule's atoms in them, by walking."""
    out = set()
    for i in range(len(atoms)):
        bonds, seen = set(), {i}
        for _ in range(radius):
            step = {(e["bond"], e["to"]) for j in seen for e in atoms[j]["near"]}
            bonds |= {b for b, _ in step}
            seen |= {t for _, t in step}
            if bonds:
                out.add(frozenset(bonds))
    return out


def test_a_label_for_each_atom_and_each_set_of_bonds(spark, found):
    """With a great many bits, and atoms all told apart by isotopes, no labels coincide."""
    rng = random.Random(2)
    strings = []
    for n in (1, 2, 3, 7, 12):
        s = "".join(f"[{100 + k}CH2]" if 0 < k < n - 1 else f"[{100 + k}CH3]" for k in range(n)) if n > 1 else "[100CH4]"
        strings.append(s)
    strings += ["[101CH2]1[102CH2][103CH2][104CH2]1", "[101CH3][102CH]([103CH3])[104CH2][105OH]"]
    rng.shuffle(strings)
    df = molecules.standardised(spark.createDataFrame(list(enumerate(strings)), "id int, s string"), "id", "s")
    for radius in (0, 1, 2, 3):
        for r in molecules.circular_bits(df, n_bits=1 << 30, radius=radius).collect():
            atoms = [a.asDict(recursive=True) for a in r["atoms"]]
            assert len(r["bits"]) == len(atoms) + len(environments(atoms, radius)), (strings[r["id"]], radius)


def test_words_hold_the_bits(found):
    for r in found.values():
        if r["bits"] is not None:
            assert sorted(64 * k + b for k, w in enumerate(r["words"]) for b in range(64) if w >> b & 1) == r["bits"]


def test_descriptors(spark):
    rows = [("aspirin", "CC(=O)Oc1ccccc1C(=O)O"), ("caffeine", "Cn1cnc2c1c(=O)n(C)c(=O)n2C"), ("butane", "CCCC"), ("glucose", "OC[C@H]1OC(O)[C@H](O)[C@@H](O)[C@@H]1O")]
    df = molecules.standardised(spark.createDataFrame(rows, "id string, s string"), "id", "s")
    got = {r["id"]: r for r in df.select("id", "formula", molecules.descriptors(F.col("atoms")).alias("d")).select("id", "formula", "d.*").collect()}
    a, c, b, g = (got[n] for n in ("aspirin", "caffeine", "butane", "glucose"))
    assert (a["formula"], a["n_rings"], a["donors"], a["acceptors"], a["rotatable"], a["aromatic"]) == ("C9H8O4", 1, 1, 4, 3, 6) and abs(a["weight"] - 180.16) < 0.01
    assert (c["formula"], c["n_rings"], c["donors"], c["n_heavy"]) == ("C8H10N4O2", 2, 0, 14) and abs(c["weight"] - 194.19) < 0.01
    assert (b["formula"], b["rotatable"], b["share_sp3"]) == ("C4H10", 1, 1.0)
    assert (g["formula"], g["donors"], g["n_rings"]) == ("C6H12O6", 5, 1) and abs(g["weight"] - 180.156) < 0.01


def test_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(1, "CCO"), (1, "CCO"), (None, "OCC")], "id int, atoms string")
    found = molecules.standardised(df, "id", "atoms").collect()
    assert len(found) == 3 and len({r["key"] for r in found}) == 1
    assert molecules.circular_bits(molecules.standardised(df.limit(0), "id", "atoms")).collect() == []


def test_bonds_are_counted():
    """A chain has one bond less than atoms, a ring as many."""
    for s in ("CCOCN", "CC(C)CO", "C1CCCCC1O"):
        atoms, bonds = smiles.molecule(s)
        assert bonds == len(atoms) - (0 if "1" in s else 1)
