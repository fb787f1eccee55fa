"""Lexical search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def by_hand(docs, items, k=10):
    found = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in found if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, want in asked.items():
        scored = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in want if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def made(rng, n, topics=8):
    common = ["the", "of", "And", "a1"]
    texts = []
    for _ in range(n):
        topic = rng.randrange(topics)
        own = [f"w{topic}x{int(rng.paretovariate(0.9)) % 60}" for _ in range(rng.randint(0, 40))]
        texts.append(rng.choice([" ", "-", ", ", "\n"]).join(rng.sample(own + common * rng.randint(0, 4), k=len(own))) if own else rng.choice(["", None, "  .. ", "the"]))
    return texts


@pytest.mark.parametrize("shard, cluster, block", [(4096, 64, 400_000), (60, 4, 400_000), (33, 1, 50)])
def test_ranking_is_what_scoring_all_finds(spark, shard, cluster, block):
    rng = random.Random(shard)
    docs = list(enumerate(made(rng, 500))) + [(i + 1000, "Ünder the wórld 日本 2nd") for i in range(25)] + [(3, "the of w1x2"), (None, "w1x2 of"), (None, "Ünder")]
    rng.shuffle(docs)
    items = [(i, t) for i, t in enumerate(made(rng, 30))] + [(100, "wórld ünder"), (101, "THE"), (102, "nowhere at-all"), (103, None), (104, ""), (None, "the"), (7, "w3x1 w3x2"), (7, "w3x1 日本")]
    found = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string"), 10, shard, cluster, block)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_hand(docs, items)


def test_bisection_brings_topics_together():
    rng = np.random.default_rng(2)
    topic = rng.integers(0, 8, 512)
    owner = np.repeat(np.arange(512), 20)
    term = topic[owner] * 50 + rng.integers(0, 50, len(owner))
    order = lexical.bisected(owner, term, 512, 32)
    assert sorted(order.tolist()) == list(range(512))
    kinds = lambda o: np.mean([len(set(topic[o[i : i + 32]])) for i in range(0, 512, 32)])
    assert kinds(order) < 0.4 * kinds(np.arange(512))


def test_clusters_are_left_out(spark, monkeypatch):
    """Bounds let most clusters be skipped where topics differ."""
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"t{i % 16}w{rng.randrange(30)}" for _ in range(30))) for i in range(2048)], "doc_id bigint, text string")
    batch = {}

    def keep(rows, total, length, cluster=lexical.CLUSTER_DOCS):
        batch["index"] = real(rows, total, length, cluster)
        return batch["index"]

    real = lexical.indexed
    monkeypatch.setattr(lexical, "indexed", keep)
    lexical.search(docs, spark.createDataFrame([(i, f"t{i}w1 t{i}w2 t{i}w5") for i in range(16)], "item_id bigint, text string"), 10, 2048, 64).collect()
    row = batch["index"].toArrow().combine_chunks().to_batches()[0]
    shard = lexical.Shard(row, 0, 64)
    bounds = shard.bounds(np.arange(0, 49, 3), np.arange(48), np.full(48, 1000))
    assert 28 <= shard.clusters <= 32 and (bounds > 0).any(axis=1).all() and (bounds > 0).mean() < 0.2


def test_small_tables(spark):
    docs = spark.createDataFrame([(2, "one two", 1), (1, "one two", 2), (3, None, 3), (None, "one two", 4), (4, "x " * 30_000 + "one", 5), (5, "three", 6)], "doc_id bigint, text string, score int")
    items = spark.createDataFrame([(9, "two", 1), (8, "", 1)], "item_id bigint, text string, rank int")
    found = lexical.search(docs, items).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in found] == [(9, 1, 1), (9, 2, 2), (9, 3, None)] and len({r["score"] for r in found}) == 1
    assert lexical.search(docs.limit(0), items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []
