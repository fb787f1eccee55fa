"""Operators that SQL cannot express, against plain Python on small tables."""

import hashlib
import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import arrays, chat, components, decontaminate, fingerprints, language, licenses, mixing, neardup, pii, queries, sampling, toxicity, urls, words


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(1.1)) % words}{rng.choice('abcde')}" for _ in range(n))


def test_near_duplicates_link_as_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(1, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            copy = [w if rng.random() > rng.choice([0, 0.03, 0.08]) else "Changed" for w in base]
            texts.append(" ".join(copy))
    texts += ["", " ", None, "one", "ONE", "two words", "Two\twords"]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    found = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 2, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}


def test_sets_of_a_repeated_id_are_all_searched(spark):
    rng = random.Random(31)
    texts = [prose(rng, 80) for _ in range(6)]
    near = [" ".join(["Changed", *t.split()[1:]]) for t in texts]
    alone = prose(rng, 80)
    # the sixth text has a smaller id than 5, and a copy of it has the repeated id
    rows = [(5, t) for t in texts] + [(20 + i, t) for i, t in enumerate(texts)] + [(40 + i, t) for i, t in enumerate(near)] + [(2, texts[5]), (60, alone)]
    want = [(i, t, 2 if t in (texts[5], near[5]) else 60 if i == 60 else 5) for i, t in rows]
    for seed in range(2):
        rng.shuffle(rows)
        found = neardup.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3 + seed), 2, 80).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in found) == sorted((i, c, i == c) for i, _, c in want)


def test_a_dropped_row_of_a_repeated_id_drops_no_other(spark):
    rng = random.Random(37)
    first, second, third = sorted(prose(rng, 80) for _ in range(3))
    near = lambda t: " ".join([*t.split()[:-1], "Changed"])
    rows = [(1, third), (5, first), (5, second), (5, third), (20, second), (21, near(second)), (22, near(first)), (23, third), (None, first)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    keep = min((second, third), key=lambda t: t != third)  # the third text's group has a smaller id than 5
    assert keep == third and {(r["doc_id"], r["text"]) for r in found} == {(1, third), (5, first), (5, second)} and len(found) == 3


def test_cells_hold_each_pair_once(spark):
    rng = random.Random(29)
    rows = [(1, i) for i in range(120)] + [(2, i) for i in range(200, 205)] + [(3, 300)]
    some = [r for r in rows if r[0] != 3 and rng.random() < 0.5]
    make = lambda x: spark.createDataFrame(x, "key int, id bigint")
    sizes = {k: (sum(r[0] == k for r in some), sum(r[0] == k for r in rows)) for k in (1, 2, 3)}
    give = lambda x: make(x).withColumn("n_few", F.create_map(*[F.lit(v) for k in sizes for v in (k, sizes[k][0])])[F.col("key")]).withColumn("n_all", F.create_map(*[F.lit(v) for k in sizes for v in (k, sizes[k][1])])[F.col("key")])
    few, all_ = neardup.dealt(give(some), True, 16), neardup.dealt(give(rows).where("n_few > 0"), False, 16)
    met = few.alias("a").join(all_.alias("b"), F.expr("a.key = b.key and a.line = b.line and a.column = b.column")).select("a.key", F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()
    assert sorted(map(tuple, met)) == sorted((k, i, j) for k, i in some for m, j in rows if m == k)
    assert all_.groupBy("key", "line", "column").count().agg(F.max("count")).first()[0] < 40


def test_pipeline_stages_as_brute_force(spark, tmp_path):
    """The whole pipeline on a table with planted cases, and each stage's decision."""
    rng = random.Random(30)
    clean = [prose(rng, 60) for _ in range(60)]
    item = "Which of these rivers flows through the old town of Kell before it meets the sea at last"
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(clean[:10])] + [(200 + i, t + " end") for i, t in enumerate(clean[10:20])]
    rows += [(300 + i, f"{prose(rng, 20)} {item} {prose(rng, 20)}") for i in range(5)] + [(400 + i, f"{prose(rng, 30)} write to me at jo{i}@mail.org please") for i in range(5)]
    rows += [(500 + i, f"{prose(rng, 30)} zork zork {prose(rng, 5)}") for i in range(20)] + [(600, None), (601, ""), (None, clean[0]), (None, "a text of its own"), (None, "a text of its own")]
    docs = spark.createDataFrame([(i, t, "en", rng.choice("abc"), len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(500 <= i < 600)) for i, _ in rows if i is not None], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/out-{name}")
        now = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = now.collect()
    ids = {k: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in v) for k, v in seen.items()}
    left = sorted(i if i is not None else -1 for i, _ in rows if i is None or not 500 <= i < 600)
    assert ids["toxicity"] == left
    left = sorted([i for i in left if i >= 0 and not 100 <= i < 300] + [-1])
    assert ids["near_duplicates"] == left
    left = [i for i in left if not 300 <= i < 400]
    assert ids["decontamination"] == ids["personal_data"] == left
    texts = {r["doc_id"]: r for r in seen["personal_data"]}
    for i, t in rows:
        if i is not None and i in texts:
            want = re.sub(r"jo\d@mail.org", "[EMAIL]", t) if t else t
            assert texts[i]["text"] == want and texts[i]["n_chars"] == len(want or "")
    assert set(ids["mixing"]) <= set(left) - {600, 601} and all(0 < r["taken"] <= 2 * r["size"] and r["text"] for r in seen["mixing"])
    sizes, taken = {}, {}
    for r in seen["personal_data"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    for r in seen["mixing"]:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    goals = dict(zip(sorted(sizes), mixing.targets([sizes[k] for k in sorted(sizes)], [3, 1, 2], 1.5, 2.0)))
    assert all(abs(taken[k] - goals[k]) <= mixing.BLOCK_WORDS for k in goals)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["taken"]) for r in whole) == sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["taken"]) for r in seen["mixing"])


def test_mix_takes_documents_in_seeded_order(spark):
    rng = random.Random(33)
    rows = [(i, prose(rng, rng.randint(0, 60)), "a") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    drawn = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(mixing.SEED))).collect()}
    found = {r["doc_id"]: r for r in mixing.mix(df, share=0.4).collect()}
    words_ = sum(len(t.split()) for _, t, _ in rows)
    left = min(2 * words_, mixing.apportion([0.4 * words_], round(0.4 * words_ / mixing.BLOCK_WORDS))[0] * mixing.BLOCK_WORDS)
    for i, t, _ in sorted(rows, key=lambda r: (drawn[r[0]], r[0])):
        n = min(left, len(t.split()))
        assert found[i]["taken"] == n
        left -= n


def plans(spark, since):
    """Names of the operators of each plan that ran since ``since`` plans had."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    graphs = [store.planGraph(i).allNodes() for i in range(since, store.executionsCount())]
    return [[g.apply(i).name() for i in range(g.size())] for g in graphs]


def test_near_duplicates_build_no_table_on_the_driver(spark):
    words = "the quick brown fox jumps over one lazy dog while rain falls on old stone walls near our mill".split()
    texts = [" ".join([*words[k % 5 :], str(k // 7)]) for k in range(60)] + [None, ""]
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert neardup.groups(docs, 2, 80).count() == len(texts)
    found = plans(spark, since)
    assert len(found) > 10 and any("SortMergeJoin" in n for names in found for n in names)
    assert not [n for names in found for n in names if n.startswith("Broadcast")]


def test_no_plan_holds_a_whole_round_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100 + i, 90) for i in range(20)], "u bigint, v bigint")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert components.components(edges).count() == 60
    assert max(map(len, plans(spark, since))) < 40


def test_roots_of_a_forest(spark):
    rng = random.Random(4)
    up = {i: rng.choice([i - 1, rng.randrange(i)]) for i in range(1, 300) if rng.random() < 0.97}

    def root(i):
        return root(up[i]) if i in up else i

    found = components.roots(spark.createDataFrame(list(up.items()), "u bigint, v bigint")).collect()
    assert {r["id"]: r["component"] for r in found} == {i: root(i) for i in up} and len(found) == len(up)
    assert components.roots(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}


def test_simhash_tables_find_all_within_radius(spark):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    prints = seeds + [s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(6)] + seeds[:3]
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")
    for radius, blocks in ((3, 6), (0, 1), (2, 4)):
        found = {(r["fingerprint"], r["other"]): (r["distance"], r["copies"]) for r in fingerprints.within(df, df, radius, blocks).collect()}
        want = {(a, b): (d, prints.count(b)) for a in set(prints) for b in set(prints) if (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= radius}
        assert found == want


def test_fingerprint_search_returns_what_it_finds(spark, tmp_path):
    rng = random.Random(41)
    texts = []
    for _ in range(20):
        base = prose(rng, 150).split()
        texts += [" ".join(base)] * 2 + [" ".join(w if rng.random() > share else "Changed" for w in base) for share in (0.02, 0.04, 0.06, 0.08) for _ in range(2)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [fingerprints.simhash(t) for t in texts]
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    result = queries.op2_fingerprints(spark, str(tmp_path))
    kinds = dict(result.dtypes)
    assert (kinds["doc_id"], kinds["n_chars"], kinds["near_edited"], kinds["near_next"]) == ("bigint", "bigint", "double", "double")
    assert kinds["fingerprint"] == kinds["edited_fingerprint"] == kinds["edited_sha256"] == "string"
    found = {r["doc_id"]: r for r in result.collect()}
    assert len(found) == len(texts) and any(3 < apart(prints[0], p) <= 8 for p in prints)
    for i in range(0, len(texts), 20):
        want = sorted((d, fingerprints.hexed(p), prints.count(p)) for p in set(prints) if (d := apart(prints[i], p)) <= 8)
        assert [tuple(n) for n in found[i]["neighbours"]] == want and found[i]["n_within_8_bits"] == sum(w[2] for w in want) - 1
        assert found[i]["n_within_3_bits"] == sum(w[2] for w in want if w[0] <= 3) - 1
    assert found[1]["neighbours"] is None and found[1]["fingerprint"] == fingerprints.hexed(prints[1])


def test_edited_texts_follow_the_next_id(spark):
    rng = random.Random(9)
    rows = [(i * 3 - 20, rng.choice(["", "é🙂", None]) if i % 7 == 0 else prose(rng, rng.randint(1, 30)) + "é🙂") for i in range(60)]
    found = {r["doc_id"]: r for r in fingerprints.edit_likeness(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        t, following = t or "", following or ""
        k = len(t) // 4
        e = t[: len(t) - k] + following[:k]
        assert found[i]["n_chars"] == len(t) and found[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert found[i]["bits"] == fingerprints.simhash(t) and found[i]["fingerprint"] == fingerprints.hexed(fingerprints.simhash(t))
        assert found[i]["edited_fingerprint"] == fingerprints.hexed(fingerprints.simhash(e))
        assert found[i]["near_next"] == fingerprints.likeness(fingerprints.simhash(t), fingerprints.simhash(following))


def test_simhash_bits_by_plain_counting():
    rng = random.Random(16)
    for n in (1, 2, 3, 40, 300):
        text = prose(rng, n, 30)
        h = [int(x) for x in words.hashed(words.words(text))]
        pairs = [int(words.windows(np.array(p, np.uint64), 2)[0]) for p in zip(h, h[1:])]
        ones = [int(words.mixed(np.array([x], np.uint64))[0]) for x in h]
        votes = [0.0] * 64
        for terms, weight in ((ones, 0.5), (pairs, 1.0)):
            for x in set(terms):
                for bit in range(64):
                    votes[bit] += weight * terms.count(x) ** 0.5 * (1 if x >> bit & 1 else -1)
        print_ = fingerprints.simhash(text)
        assert all((print_ >> bit & 1) == (v > 0) for bit, v in enumerate(votes) if abs(v) > 1e-3)
    assert fingerprints.simhash("") == fingerprints.simhash(None) == fingerprints.simhash(" ") == 0


def test_rows_of_one_id_or_none_spread_over_tasks(spark):
    rng = random.Random(17)
    rows = [(None if i % 2 else (7 if i % 3 else i), prose(rng, 6)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed = fingerprints.neighbours(df, 16).where("not ghost").groupBy("bucket", "doc_id").count().collect()
    assert sum(r["count"] for r in placed) == 900 and max(r["count"] for r in placed) < 120
    found = fingerprints.edit_likeness(df).collect()
    order = df.withColumn("tie", F.xxhash64("text")).orderBy("doc_id", "tie", "text").collect()
    want = []
    for a, b in zip(order, order[1:] + order[:1]):
        e = fingerprints.edited(a["text"], b["text"])
        want.append((a["doc_id"] is not None, a["doc_id"] or 0, fingerprints.simhash(a["text"]), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["bits"], r["edited_sha256"]) for r in found) == sorted(want)


def test_words_of_many_texts_at_a_time():
    rng = random.Random(34)
    texts = [rng.choice([None, "", " ", prose(rng, rng.choice([1, 50, 60_000])), " A b\t\x0bc\n", "x\x85y\u3000 É"]) for _ in range(400)]
    assert sum(len(t or "") for t in texts) > words.PART_BYTES
    for made in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()), pa.array(["z z"] * 7 + texts).slice(7)):
        for t, h in zip(texts, words.hashes(made)):
            want = words.hashed(words.words(t))
            assert len(h) == len(want) and (h == want).all()
        rows, codes = [], []
        for first, part in words.parts(made):
            row, code, _, _ = decontaminate.templates(part)
            rows.append(row + first), codes.append(code)
        rows, codes = np.concatenate(rows), np.concatenate(codes)
        for i in range(0, 400, 17):
            assert (codes[rows == i] == decontaminate.templates(pa.array([texts[i]], pa.string()))[1]).all()


def test_apportion_is_sainte_lague():
    rng = random.Random(1)
    for _ in range(60):
        votes = [rng.choice([0, 1, 5, rng.random() * 1000]) for _ in range(rng.randint(1, 9))]
        seats = rng.randint(0, 80)
        want = [0] * len(votes)
        if sum(votes):
            for _ in range(seats):
                i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
                want[i] += 1
        got = mixing.apportion(votes, seats)
        assert sum(got) == sum(want) and all(abs(a - b) <= (0 if len(set(votes)) == len(votes) else 1) for a, b in zip(got, want))


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 300)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(df).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    goals = dict(zip(size, mixing.targets(list(size.values()), [3, 1, 2, 3], 1.5, 2.0)))
    by = {i: s for i, _, s in rows}
    for s in size:
        own = [r for r in found if by[r["doc_id"]] == s]
        assert all(r["source_size"] == size[s] and abs(r["target"] - goals[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - goals[s]) <= mixing.BLOCK_WORDS
        assert goals[s] <= 2 * size[s] + 1e-9


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 100, 100], [3, 1, 2], 1.5, 2.0) == [20, 295 / 3, 590 / 3]
    assert mixing.targets([10, 10, 200], [3, 1, 2], 1.5, 2.0) == [20, 20, 290]
    assert mixing.targets([], [], 1.5, 2.0) == [] and mixing.targets([0, 0], [1, 1], 1.5, 2.0) == [0, 0]


def test_base_spans_match_the_rules(spark):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def passes(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    rng = random.Random(4)
    bits = ["a@b.co", "x_y@z", "@", ".", "+", "4111111111111111", "4111-1111 1111-1111", "1.2.3.4", "256.1.1.1", "00255.9.9.9", "+1 (988) 555-2485", "é🙂", " ", "-", "7", "12", "(", ")", "\n", "a", "%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)] + [None, "", "a@b.cc " * 700]
    found = pii.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in found:
        t = texts[r["doc_id"]] or ""
        want = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if passes(k, m[0])]
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["candidates"] if s["base"]] == want


def test_personal_data_query_counts_each_kind(spark, tmp_path):
    rng = random.Random(25)
    bits = ["a@b.co", "c.d@e.org", "4111111111111111", "1.2.3.4", "+1 (988) 555-2485", "and", "phone:", "(988) 555-2485", "jo [at] x [dot] com"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    result = queries.op5_personal_data(spark, str(tmp_path))
    assert dict(result.dtypes) == {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    size = {"card": range(16, 20), "phone": range(8, 16)}
    for r in result.collect():
        t = texts[r["doc_id"]] or ""
        base = [(k, m.start(), m.end()) for k, p in rules.items() for m in re.finditer(p, t) if k not in size or len(re.sub("[^0-9]", "", m[0])) in size[k]]
        base = [b for b in base if b[0] != "card" or re.sub("[^0-9]", "", t[b[1] : b[2]]) == "4111111111111111"]
        assert [r[f"n_{k}"] for k in rules] == [sum(b[0] == k for b in base) for k in rules], t
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r["spans"].split(","))


def test_running_and_between(spark):
    rng = random.Random(26)
    rows = [(i, [rng.randint(-5, 9) for _ in range(n)], "".join(rng.choice("aé🙂\n") for _ in range(n)), rng.randint(0, n), n) for i, n in enumerate((0, 1, 2, 255, 256, 257, 512, 1023, 1024, 1025, 3000))]
    df = spark.createDataFrame(rows, "i int, a array<int>, t string, x int, n int").withColumn("cut", arrays.pieces(F.col("t")))
    out = df.select("i", arrays.running(F.col("a")).alias("s"), arrays.running(F.col("a"), F.greatest, -9).alias("m"), arrays.between(F.col("cut"), F.col("x"), F.col("n")).alias("p"), arrays.between(F.col("cut"), F.lit(0), F.col("x")).alias("q"))
    for r in out.collect():
        _, a, t, x, n = rows[r["i"]]
        assert r["s"] == [sum(a[: k + 1]) for k in range(len(a))] and r["m"] == [max(a[: k + 1]) for k in range(len(a))] and (r["q"], r["p"]) == (t[:x], t[x:n])


def test_wide_spans_lie_outside_of_base_spans(spark):
    rng = random.Random(27)
    spans = lambda n, most: sorted({(a := rng.randint(0, 300), a + rng.randint(1, most)) for _ in range(n)})

    def disjoint(found):
        out = []
        for a, b in found:
            if not out or a >= out[-1][1]:
                out.append((a, b))
        return out

    rows = [(i, [disjoint(spans(rng.randint(0, 12), 60)) for _ in pii.KINDS], [disjoint(spans(rng.randint(0, 12), 30)) for _ in pii.KINDS]) for i in range(100)]
    full = lambda found: [[(a, b, "", "", "") for a, b in f] for f in found]
    kinds = ", ".join(f"_{n}_{k} {pii.SPANS}" for n in ("own", "wide") for k in pii.KINDS)
    step = spark.createDataFrame([(i, *full(o), *full(w)) for i, o, w in rows], f"i int, {kinds}")
    for name, c in pii._apart().items():
        step = step.withColumn(name, c)
    for r in step.select("i", "_apart").collect():
        _, own, wide = rows[r["i"]]
        want = [(k, a, b) for k in range(4) for a, b in wide[k] if not any(x < b and y > a for x, y in own[k])]
        assert [(z["x"]["kind"], z["x"]["s"]["start"], z["x"]["s"]["end"]) for z in r["_apart"] or []] == want


def test_redaction_as_brute_force(spark):
    rng = random.Random(28)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab é🙂\n") for _ in range(rng.choice([0, 50, 1500, 5000])))
        n = rng.choice([0, 1, 5, 400]) if len(text) > 1 else 0
        spans = sorted({(rng.randrange(4), a := rng.randrange(len(text)), min(len(text), a + rng.randint(1, 20))) for _ in range(n)})
        rows.append((i, text, [(k, a, b, True, [1, 1, 1, 1, 1], 0) for k, a, b in spans], "kept"))
    kind = "doc_id bigint, text string, candidates array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,form:int>>, _spans string"
    found = pii.redacted(spark.createDataFrame(rows, kind), pii.Model())
    assert found.columns == ["doc_id", "text", "_spans"]
    for r in found.collect():
        _, text, spans, _ = rows[r["doc_id"]]
        groups = []
        for a, b, k in sorted((s[1], s[2], s[0]) for s in spans):
            if groups and a < groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], b)
            else:
                groups.append([a, b, k])
        want, at = "", 0
        for a, b, k in groups:
            want += text[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = b
        assert r["text"] == want + text[at:] and r["_spans"] == "kept"


def test_dense_spans_take_time_in_proportion(spark):
    line, took = "mail a@bb.com or +1 988 555 2485 ", []
    for n in (4_000, 16_000):
        df = spark.createDataFrame([(1, line * n)], "doc_id bigint, text string")
        start = time.perf_counter()
        found = pii.redacted(pii.labelled(df), pii.Model()).first()["text"]
        took.append(time.perf_counter() - start)
        assert found == "mail [EMAIL] or [PHONE] " * n
    print("dense spans", took)
    assert took[1] < 10 * took[0]


def test_vote_and_redaction(spark):
    texts = ["call me (988) 555-2485 today", "mail a@b.com or +1 (988) 555-2485", "write to jo [at] example [dot] com", "see version 1.2.3 of it"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.labelled(df)
    model = pii.fit(found)
    new = {r["doc_id"]: r["text"] for r in pii.redacted(pii.labelled(df), model).collect()}
    assert new[0] == "call me [PHONE] today" and new[1] == "mail [EMAIL] or [PHONE]" and new[3] == texts[3]


def test_reply_tree_paths(spark):
    rng = random.Random(6)
    rows, parents = [], {}
    for tree in range(4):
        for node in range(40):
            parent = None if node == 0 else (node - 1 if tree == 0 else rng.randrange(node))
            parents[tree, node] = parent
            rows.append((tree, node, parent, rng.random(), rng.choice(["user", "assistant"]), rng.choice(["a<b&c>", "</turn>\n<turn:user>", "é🙂", "", "<é🙂" * 700])))
    df = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, score double, role string, text string")
    said = {(r[0], r[1]): r for r in rows}
    want = {}
    for tree, node in parents:
        if not any(p == node for (t, _), p in parents.items() if t == tree):
            path, at = [], node
            while at is not None:
                path.append(at)
                at = parents[tree, at]
            want[tree, node] = path[::-1]
    out = chat.formatted(df).withColumns({"back": chat.read_back(F.col("formatted")), "cut": arrays.pieces(F.col("formatted"))})
    out = out.withColumn("loss", chat.loss_text(F.col("cut"), F.col("loss_mask"))).collect()
    assert {(r["tree"], r["leaf"]) for r in out} == set(want)
    for r in out:
        turns = [said[r["tree"], n] for n in want[r["tree"], r["leaf"]]]
        assert [(t["role"], t["text"]) for t in r["back"]] == [(t[4], t[5]) for t in turns]
        assert r["loss"] == "".join(t[5] for t in turns if t[4] == "assistant")
    best = chat.paths(df, 1).groupBy("tree").agg(F.count_distinct("leaf").alias("n"), F.first("leaf").alias("leaf")).collect()
    score = lambda k: sum(said[k[0], n][3] for n in want[k]) / len(want[k])
    for r in best:
        assert r["n"] == 1 and (r["tree"], r["leaf"]) == max((k for k in want if k[0] == r["tree"]), key=score)


def test_reparameterised_items_are_leaks(spark):
    bench = spark.createDataFrame([(9, "Then Mary bought 30 apples and 4 pears at the market in London, then Mary gave 30 apples to Jim for 9kg of flour.")], "item_id bigint, text string")
    told = "So it was. We know that {} bought {} apples and 7 pears at the market in Rome, then {} gave {} apples to Bob for 5 kg of flour. The end"
    rows = [(1, told.format("Anna", 12, "Anna", 12)), (2, told.format("Anna", 12, "Zoe", 13)), (3, told.format("Anna", 12, "Anna", 12).upper()), (4, "nothing of the kind")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = decontaminate.leaks(df, bench).join(df.withColumn("k", decontaminate.text_key(F.col("text"))), F.col("k") == F.col("text_key"))
    found = {r["doc_id"]: r["altered"] for r in held.collect()}
    assert found.get(1) == 6 and 2 not in found and 4 not in found


def test_verbatim_items_of_any_length_are_leaks(spark):
    rng = random.Random(15)
    word = lambda: rng.choice(["Anna", "12", "kg", "ate", "the", "Rome", "3.5", "red", "fox", "of", "7kg", "Bob,", "end.", "why?", "so"])
    items = ["big red fox", "yes", "12 Anna 7 Bob 9 kg Rome 14 Zoe 3 km 8 Lima 5 York", "Paris 9", "4 5 6 7 8 9 10 11 12 13"] + [" ".join(word() for _ in range(n)) for n in range(2, 30) for _ in range(2)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [f"{' '.join(word() for _ in range(rng.randint(0, 9)))} {t.upper() if i % 3 == 0 else t} {' '.join(word() for _ in range(rng.randint(0, 9)))}" for i, t in enumerate(items)] + ["quite another thing", "\n\n", "yes" * 3]
    core = lambda t: [p for w in re.sub(r"(\d)([^\W\d_]{1,8})(?=\W|$)", r"\1 \2", t).split() if (p := w.strip(",.?").lower())]
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    held = decontaminate.leaks(df, bench).join(df.withColumn("k", decontaminate.text_key(F.col("text"))), F.col("k") == F.col("text_key")).collect()
    found = {(r["doc_id"], r["item_id"]): r for r in held}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            if inside(core(item), core(t)):
                assert found[d, i]["share"] == 1.0 and found[d, i]["covered"] == len(core(item)), (item, t)
            elif len(core(item)) < 4:
                assert (d, i) not in found, (item, t)
    assert not any(d >= len(items) for d, _ in found)


def wording_text(w):
    return re.sub("<[^>]*>", "the University of Somewhere", w)


def test_license_wordings():
    scanner = licenses.Scanner()
    for name, wordings in licenses.TEMPLATES.items():
        for w in wordings:
            text = "before it. " + wording_text(w).replace(" ", "\n", 3) + " after it"
            assert [(f[0], f[5]) for f in scanner.scan(text)] == [(name, [])], (name, w)
    changed = licenses.TEMPLATES["MIT"][2].replace("merge", "fuse")
    assert [(f[0], f[5]) for f in scanner.scan(changed)] == [("MIT", ["-merge+fuse"])]
    assert scanner.scan("Licensed under CC BY 4.0.")[0][0] == "CC-BY-4.0"
    assert scanner.scan("the license of the copyright " * 500) == []
    assert scanner.scan("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.") == []


def test_any_one_word_of_a_wording_may_change():
    scanner = licenses.Scanner()
    seen = 0
    for item in scanner.items:
        text = wording_text(licenses.TEMPLATES[item.license][item.no])
        spans = licenses.tokens(text)
        place, at = {}, 0
        for i, w in enumerate(item.words):
            if w == "<>":
                at += 4
            else:
                place[i] = at
                at += 1
        for i, k in place.items():
            _, start, end = spans[k]
            for new in ("otherwise", ""):
                found = scanner.scan(f"so we say: {text[:start]}{new}{text[end:]} and that is it")
                if item.changes and i not in item.fixed:
                    assert [(f[0], len(f[5])) for f in found] == [(item.license, 1)], (item.license, item.no, item.words[i], new, found)
                    seen += 1
    assert seen > 1000


def test_own_templates_need_no_cue_word():
    own = {"X": ["Whoever reads these lines may sing them aloud wherever the sun shines."], "Y": ["take it"]}
    scanner = licenses.Scanner(own)
    assert [f[0] for f in scanner.scan("Hear: " + own["X"][0] + " Now take it, all.")] == ["X", "Y"]
    assert [(f[0], f[5]) for f in scanner.scan(own["X"][0].replace("sing", "hum"))] == [("X", ["-sing+hum"])]
    assert scanner.scan("Whoever reads these lines may go") == [] and licenses.Scanner({}).scan("take it") == []


def test_alignment_is_the_least_number_of_changes():
    rng = random.Random(18)

    def least(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        n, first, last, edits = licenses.aligned(a, b)
        assert n == least(a, b) == len(edits) and least(a, b[first:last]) == n


def test_folding_and_exceptions():
    assert toxicity.folded("M0R0N, Dіѕgustinǵ! straße") == " moron disgusting strasse " or toxicity.folded("M0R0N") == " moron "
    lexicon = toxicity.Lexicon({" trash": 5.0}, {"trash can"})
    m = toxicity.Matcher(lexicon)
    assert len(m.hits(toxicity.folded("TR4SH and trash can"))) == 1


def test_toxicity_learns_words(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(20, 200)) + (" zork zork" if i % 6 == 0 else ""), int(i % 6 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    lexicon = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    assert " zork" in lexicon.weights or " zork " in lexicon.weights
    found = toxicity.score(docs, lexicon).collect()
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 6 == 0) for r in found) >= 597


def test_language_profiles_tell_alphabets_apart(spark):
    rng = random.Random(11)
    letters = {"aa": "etaoinshr", "bb": "eñaoslcióu", "cc": "éèençuoit", "dd": "абвгдежзи"}
    write = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(i, write(k := rng.choice(list(letters)), rng.randint(8, 60)), k) for i in range(400)] + [(1000, "12 34 !", "aa"), (1001, None, "bb"), (1002, write("aa", 20), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df.select("doc_id", "text"), language.fit(df, F.col("doc_id") % 5 != 0)).collect()}
    held = [(found[i][0], k) for i, _, k in rows[:400] if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert found[1000] == ("und", 0.0) and found[1001] == ("und", 0.0) and found[1002][0] == "aa"


def test_rules_as_brute_force(spark):
    rng = random.Random(12)
    part = lambda: rng.choice(["a", "b", "cc", "com", "net"])
    rules = sorted({(".".join(part() for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice(["x/", "y/", "x", "yy"]) for _ in range(rng.randint(0, 3)))): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    pages = [(i, rng.choice(["http://", "https://", ""]) + ".".join(part() for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/x/y/", "/x/yy/x?y", "/yyx#a", "/x/x/x"])) for i in range(300)]
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    for most in (1000, 0):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, table, "allow", most).collect()}
        for i, u in pages:
            rest = u.partition("://")[2]
            host = re.split("[/?#]", rest)[0].lower() if "://" in u else ""
            path = re.split("[?#]", rest[len(host):])[0] if "://" in u else ""
            fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits)[:2] if fits else None
            want = {(r, v) for n, k, r, v in fits if (n, k) == best} if fits else {(None, "allow")}
            assert got[i] in want, (u, got[i], want)


def test_many_licenses_in_one_block():
    lines = [w for wordings in licenses.TEMPLATES.values() for w in wordings if len(w) < 120]
    text = " and ".join(lines)
    assert len(licenses.Scanner().scan(text)) == len(lines)


def test_samples_are_the_smallest_hashes(spark):
    ids = spark.range(5000).select(F.col("id").alias("doc_id"))
    want = sorted(r[0] for r in ids.orderBy(F.xxhash64("doc_id")).limit(300).collect())
    many = ids.withColumn("x", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 2 == 0, 100).otherwise(3))))
    for rows in (ids, ids.repartition(9), many.select("doc_id")):
        assert sorted(r[0] for r in sampling.smallest_hashes(rows, "doc_id", 300).collect()) == want
    assert {(r["doc_id"], r["x"]) for r in sampling.smallest_hashes(many, "doc_id", 300).collect()} == {(i, 1) for i in want}
    assert sampling.smallest_hashes(ids.unionByName(ids), "doc_id", 9000).count() == 5000


def test_language_named_by_the_empty_string(spark):
    rng = random.Random(21)
    write = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(30))
    rows = [(i, write("abcde" if i % 2 else "fghij"), "pl" if i % 2 else "") for i in range(60)]
    df = spark.createDataFrame(rows + [(70, "abcd" * 9, None), (71, "0", "pl")], "doc_id bigint, text string, lang string")
    profiles = language.fit(df, F.lit(True))
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, profiles).collect()}
    assert all(found[i] == k for i, _, k in rows) and found[70] == "pl" and found[71] == "und"


def test_language_is_the_nearest_prototype_by_cosine(spark):
    rng = random.Random(22)
    write = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(20))
    rows = [(i, write(["abcdefg", "cdefghi", "efghijk"][i % 3]), "xyz"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, language.fit(df, F.col("doc_id") >= 30)).collect()}
    encoder = language.Encoder(language.DIM)

    def trigrams(text):
        s = " " + " ".join(re.findall("[a-z]+", text.lower())) + " "
        out = np.zeros(language.DIM)
        grams = [s[i : i + 3] for i in range(len(s) - 2)]
        for g in set(grams):
            a, b, c = (encoder.letter(0 if x == " " else ord(x)).astype(float) for x in g)
            out += grams.count(g) ** 0.5 * np.roll(a, 2) * np.roll(b, 1) * c
        return out / np.linalg.norm(out)

    bundles = {k: np.mean([trigrams(t) for i, t, x in rows if x == k and i >= 30], axis=0) for k in "xyz"}
    mean = sum(bundles.values()) / 3
    for i, t, _ in rows:
        v = trigrams(t) - mean
        cosines = {k: float(v @ (b - mean)) / np.linalg.norm(b - mean) / np.linalg.norm(v) for k, b in bundles.items()}
        best = max(cosines, key=cosines.get)
        assert found[i] == best or cosines[best] - cosines[found[i]] < 1e-4


def test_toxicity_learns_short_words_and_inner_runs(spark):
    rng = random.Random(23)
    for sign, rest in (("zk", lambda: prose(rng, rng.randint(10, 60))), ("坏蛋", lambda: "".join(rng.choice("我们今天去了公园看见花草树木很漂亮") for _ in range(rng.randint(20, 60))))):
        rows = []
        for i in range(400):
            text = rest()
            if i % 5 == 1:
                cut = rng.randrange(len(text)) if sign != "zk" else text.find(" ") + 1
                text = text[:cut] + (sign if sign != "zk" else f"{sign} ") + text[cut:]
            rows.append((i, text, int(i % 5 == 1)))
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
        labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
        lexicon = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0)
        assert (" zk " if sign == "zk" else sign) in lexicon.weights
        found = toxicity.score(docs, lexicon).collect()
        assert sum((r["score"] >= 0.5) == (r["doc_id"] % 5 == 1) for r in found) >= 396


def test_toxicity_score_of_a_given_lexicon(spark):
    lexicon = toxicity.Lexicon({" vile": 2.0, " bad ": 1.0, " badly ": 3.0, "坏蛋": 1.5}, {"bad luck", "vile weather today"}, 0.5, 2.0, -4.0)
    rng = random.Random(24)
    parts = ["vile", "vil3r", "bad", "BAD", "badly", "luck", "weather", "today", "good", "坏蛋", "是坏蛋吗", "b-a-d", "ｂａｄ"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in toxicity.score(docs, lexicon).collect():
        t = toxicity.folded(texts[r["doc_id"]])
        hits = {}
        for p, w in lexicon.weights.items():
            for m in re.finditer(f"(?={re.escape(p)})", t):
                hits[m.start()] = max(hits.get(m.start(), 0), w)
        for e in lexicon.exceptions:
            for m in re.finditer(f"(?= {re.escape(e)} )", t):
                hits = {at: w for at, w in hits.items() if not m.start() <= at < m.start() + len(e) + 1}
        z = 2.0 * toxicity.feature(sum(hits.values()), toxicity._length(t), 0.5) - 4.0
        assert abs(r["score"] - 1 / (1 + 2.718281828459045 ** -z)) < 1e-9, (t, hits)


def test_exceptions_take_one_sweep():
    lexicon = toxicity.Lexicon({" vile": 2.0}, {"vile weather"})
    m = toxicity.Matcher(lexicon)
    took = []
    for n in (20_000, 80_000):
        text = toxicity.folded("vile weather vile day " * n)
        start = time.perf_counter()
        assert len(m.hits(text)) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 16 * took[0] + 0.5
