"""Exact duplicates against grouping in plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import exact


@pytest.mark.parametrize("most", [0, 1, 5, 1000, 2**40, 2**62])
def test_codes_read_back(most):
    rng = random.Random(most)
    for n in (0, 1, 2, 7, 300):
        values = np.array(sorted({rng.randint(0, most) for _ in range(n)}), np.uint64)
        code = exact.coded(values)
        assert exact.decoded(code).tolist() == values.tolist()
        if n == 300 and most == 2**40:
            assert len(code) < 8 * n  # shorter than plain numbers


def by_hand(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append(i)
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(rows[i][0], rows[keep][0], len(members), i == keep, digest) for i in members]
    return sorted(out, key=repr)


def texts(rng, n):
    made = ["".join(rng.choices(["a", "b", "é", "日", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\xa0"], [6, 6, 2, 1, 5, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 9))) for _ in range(n)]
    return [*made, None, "", " ", "x" * 50_000, "x " * 50_000]


@pytest.mark.parametrize("spare, large", [(exact.SPARE_BITS, 1000), (-3, 3)])
def test_groups_are_what_grouping_finds(spark, monkeypatch, spare, large):
    monkeypatch.setattr(exact, "LARGE_GROUPS", large)
    monkeypatch.setattr(exact, "SPARE_BITS", spare)  # with few bits most suspects are so by chance, and the bytes decide
    monkeypatch.setattr(exact, "LEAST_OWNED", 40)
    rng = random.Random(4)
    rows = [(rng.choice([i, i, i, 5, None, -i]), t) for i, t in enumerate(texts(rng, 400) + texts(rng, 300))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    found = exact.duplicates(docs)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_hand(rows)


def test_filters_hold_all_repeats_and_little_else(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) - 2**63 for _ in range(3000)]
    rows = [(i % 5, p) for i, p in enumerate(prints)] + [(rng.randrange(5), p) for p in prints[:100]] + [(3, prints[-1])] * 200
    found = exact.repeated(spark.createDataFrame(rows, "sender int, print bigint"), 30, 6).collect()
    slots = {r["sender"]: (r["mask"], r["words"]) for r in found}
    hit = lambda s, p: s in slots and slots[s][1][(p & slots[s][0]) >> 6] >> ((p & slots[s][0]) & 63) & 1
    twice = {*prints[:100], prints[-1]}
    assert all(hit(s, p) for s, p in rows if p in twice)
    assert sum(bool(hit(s, p)) for s, p in rows if p not in twice) < 0.05 * len(prints)


def test_small_tables(spark):
    docs = spark.createDataFrame([(None, " ", 1), (None, None, 2), (7, "a b", 3), (7, "a b", 3), (8, "ab", 4), (9, "c", 5)], "doc_id bigint, text string, no int")
    found = exact.duplicates(docs)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()), key=repr)
    assert got == sorted([(None, None, 2, True), (None, None, 2, False), (7, 7, 3, True), (7, 7, 3, False), (8, 7, 3, False), (9, 9, 1, True)], key=repr)
    assert exact.duplicates(docs.limit(0)).collect() == []


def test_texts_do_not_leave_their_bucket_but_for_suspects(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    plan = exact.duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "norm" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
