"""Token alignment against plain loops over byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import alignment

STRANGE = [
    "", None, " ", "  ", "a", "a b", " a  b   c ", "tab\there\r\nline\n\n  next", "end with space ", "it's they'll <|endoftext|> </s> <s>", "ünïcødé 日本語 テスト 😀👩‍👩‍👧 é",
    "low▁line stays out", "nul\x00byte", "no break　wide sep\x1cfs x", "1234567 3.14 x=y;\r\n};\r z", "x" * 3000, "ab " * 2000, "﻿bom", "naïve  \n\n\n\t\t x", "Ａｆｕｌｌ ﬁ ①",
    "\n\nleading", "\tstart", "word\n", "word \n", ".", "...", "a.b.c", "᠎ mongolian᠎ sep",
]


def by_loops(text):
    """Whole-text encoding, no units: (n_a, n_b, groups, links) or None."""
    p = alignment.pair()
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = p.a.encode(" " + text, add_special_tokens=False).ids, p.b.encode(text)
    ta, tb = [p.bytes_a[i] for i in a], [p.bytes_b[i] for i in b]
    if b"".join(ta) != raw or b"".join(tb) != raw:
        return None
    ends_a, ends_b = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
    both = sorted(set(ends_a) & set(ends_b))
    groups, links, low = [], [], 0
    for e in both:
        ga, gb = [i for i, x in zip(a, ends_a) if low < x <= e], [i for i, x in zip(b, ends_b) if low < x <= e]
        groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
        links.append((ga[-1], gb[-1]))
        low = e
    return len(a), len(b), groups, links


def expected(texts):
    found = [by_loops(t) for t in texts]
    counts = Counter(link for x in found if x for link in x[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for x in found:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        best = sum(counts[link] == most[link[1]] for link in links)
        rows.append((n_a, n_b, len(groups), len(links), best, sum(counts[link] for link in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


def made(seed, n):
    rng = random.Random(seed)
    signs = ["a", "Be", "the", " ", "  ", "\n", ".", ",", "'s", "ü", "日", "😀", "\t", "12", "-", "▁", "\r", ";\r", "\xa0"]
    weights = [8, 8, 8, 20, 2, 2, 3, 3, 1, 2, 1, 1, 1, 2, 1, 0.02, 0.3, 0.3, 0.3]
    return ["".join(rng.choices(signs, weights, k=rng.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("held", [alignment.HELD_PAIRS, 40, 1])
def test_alignment_is_what_loops_find(spark, held):
    texts = STRANGE + made(5, 150) + made(5, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = {r["doc_id"]: tuple(r[c] for c in names) for r in alignment.scored(docs, held).collect()}
    want = expected(texts)
    assert len(found) == len(texts) and [found[i] for i in range(len(texts))] == want


def test_a_small_memory_of_units_changes_nothing(spark, monkeypatch):
    texts = made(9, 60)
    p = alignment.pair()
    units = [u for t in texts if t for u in p.units(" " + t)]
    one = alignment.Units(p)
    at = one.numbers(units)
    other = alignment.Units(p)
    for u, i in zip(units[:300], at[:300]):
        other.forget()
        j = other.numbers([u])[0]
        assert other.said[j] == one.said[i] and other.ok[j] == one.ok[i] and other.counts[j].tolist() == one.counts[i].tolist()
        assert other.links.tolist() == one.links[one.starts[i] : one.starts[i + 1]].tolist()


def test_links_of_every_kind():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 30)
        ends = [np.array(sorted({n, *rng.sample(range(1, n + 1), rng.randint(1, n))})) for _ in range(2)]
        spans = [list(zip([0, *e[:-1]], e)) for e in ends]
        o = alignment.overlaps(*ends)
        pairs = lambda kind: sorted(zip(*(x.tolist() for x in o.links(kind))))
        every = [(i, j) for i in range(len(spans[0])) for j in range(len(spans[1]))]
        assert pairs("ends") == [(i, j) for i, j in every if spans[0][i][1] == spans[1][j][1]]
        assert pairs("overlaps") == [(i, j) for i, j in every if max(spans[0][i][0], spans[1][j][0]) < min(spans[0][i][1], spans[1][j][1])]
        both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        group = lambda e: sum(b < e for b in both)
        assert pairs("groups") == [(i, j) for i, j in every if group(spans[0][i][1]) == group(spans[1][j][1])]


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "same text", 7), (1, "same text", 8), (None, "other", 9), (2, None, None), (3, "", 1)], "doc_id bigint, text string, n_a int")
    found = alignment.scored(docs).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r["doc_id"] for r in found] == [None, 1, 1, 2, 3]
    assert found[1][1:] == found[2][1:] and found[1]["count_sum"] == 4 and found[1]["n_best"] == found[1]["n_links"] == 2
    assert found[3][1:] == found[4][1:] == (0, 0, 0, 0, "", 0, 0)
    assert alignment.scored(docs.limit(0)).collect() == []
