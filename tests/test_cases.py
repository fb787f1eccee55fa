"""Small cases with known answers, and rules against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import citations, numbers, paths, text
from quern.operators import checks, compounds, curation, metrics, ml, queries, ranges, ranking, retrieval
from quern.sources import files
from quern.streaming import jobs, streams


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column).first()[0]


def test_retrieval_measures(spark):
    hits = spark.createDataFrame([("q", "other", 1), ("q", "a", 2), ("q", "b", 3)], "query_id string, item string, rank int")
    want = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 1.0), ("p", "x", 1.0)], "query_id string, item string, relevance double")
    recall = {r["query_id"]: r["recall"] for r in metrics.recall_at(hits, want, 2).collect()}
    assert recall == {"q": 0.5, "p": 0.0}
    assert {r["query_id"]: r["rr"] for r in metrics.reciprocal_rank(hits, want).collect()} == {"q": 0.5, "p": 0.0}
    ndcg = {r["query_id"]: r["ndcg"] for r in metrics.ndcg_at(hits, want, 3).collect()}
    assert 0 < ndcg["q"] < 1 and ndcg["p"] == 0


def test_graded_measures_are_those_item_by_item(spark):
    rng = random.Random(4)
    grades = {(q, i): rng.choice([1.0, 2.0, 3.0]) for q in "abc" for i in range(40) if rng.random() < 0.5}
    ranked = [(q, i, r + 1) for q in "abcd" for r, i in enumerate(rng.sample(range(40), 25))]
    hits = spark.createDataFrame(ranked, "query_id string, item int, rank int")
    want = spark.createDataFrame([(q, i, g) for (q, i), g in grades.items()], "query_id string, item int, relevance double")
    graded = hits.join(want, ["query_id", "item"], "left").select("query_id", "rank", "relevance")
    found = metrics.graded_measures(graded, want.groupBy("query_id", "relevance").agg(F.count("*").alias("n")), 20)
    slow = metrics.recall_at(hits, want, 20).join(metrics.reciprocal_rank(hits, want), "query_id").join(metrics.ndcg_at(hits, want, 20), "query_id")
    rows = lambda df: sorted((r["query_id"], round(r["recall"], 9), round(r["rr"], 9), round(r["ndcg"], 9)) for r in df.collect())
    assert rows(found) == rows(slow) and len(rows(found)) == 3


def test_release_gates(spark):
    good = {m: 0.95 for m, *_ in metrics.GATES} | {"high_severity_hallucinations": 0.0, "citation_precision": 0.92}
    run = lambda d: spark.createDataFrame([(k, v, 0.95) for k, v in d.items()], "metric string, current double, baseline double")
    verdict = lambda d: tuple(metrics.released(metrics.gates(run(d))).first())
    assert verdict(good) == (True, True)
    assert verdict(good | {"citation_precision": 0.89}) == (True, False)
    assert verdict({k: v for k, v in good.items() if k != "mrr"}) == (False, False)
    assert verdict({k: v for k, v in good.items() if k != "high_severity_hallucinations"}) == (True, False)
    two = run(good).withColumn("release", F.lit("x")).union(run(good | {"citation_precision": 0.89}).withColumn("release", F.lit("y")))
    assert {r["release"]: r["passed"] for r in metrics.released(metrics.gates(two, ["release"]), ["release"]).collect()} == {"x": True, "y": False}


def test_duplicate_hits_merge(spark):
    hits = spark.createDataFrame([(0, "k", 0.2, 1), (1, "k", 0.9, 5), (1, "j", 0.5, 2)], "query_id int, key string, score double, rank int")
    assert {(r["key"], r["score"], r["query_id"]) for r in retrieval.merged(hits, ["key"]).collect()} == {("k", 0.9, 1), ("j", 0.5, 1)}


def test_search_in_blocks_is_the_same(spark):
    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)], "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(7)], "query_id bigint, query array<float>")
    rows = lambda b: sorted((r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.search(vectors, asked, 5, block=b).collect())
    assert rows(4096) == rows(2) and len(rows(2)) == 35
    q = asked.first()
    assert [r["vec_id"] for r in retrieval.top_k(vectors, q["query"], 5).collect()] == [v for a, v, r in sorted(rows(4096), key=lambda x: x[2]) if a == q["query_id"]]


def loop(rows, start, step, least, target):
    """The rule itself: lower the threshold until enough papers are in."""
    t = start
    papers = lambda t: {p for p, s in rows if s >= t}
    while len(papers(t)) < target and t > least:
        t = max(least, t - step)
    return t, len(papers(t)) < target


def test_relaxed_threshold_is_the_loop(spark):
    rng = random.Random(2)
    cases = {i: [(rng.randrange(8), round(rng.random() * 0.6, 3)) for _ in range(rng.randint(1, 14))] for i in range(60)}
    df = spark.createDataFrame([(i, p, s, j) for i, rows in cases.items() for j, (p, s) in enumerate(rows)], "q int, paper int, score double, id int")
    for start, step, least, target in ((0.4, 0.05, 0.1, 4), (0.3, 0.07, 0.0, 6), (0.2, 0.05, 0.2, 1)):
        found = {r["q"]: (r["effective_threshold"], r["fallback_used"]) for r in retrieval.relaxed_threshold(df, "q", "paper", start, step, least, target).collect()}
        assert found == {i: loop(rows, start, step, least, target) for i, rows in cases.items()}


def test_diversified_is_the_loop(spark):
    rng = random.Random(3)
    cases = {i: [(rng.randrange(5), round(rng.random(), 6), j) for j in range(40)] for i in range(12)}
    df = spark.createDataFrame([(i, p, s, j) for i, rows in cases.items() for p, s, j in rows], "q int, paper int, score double, id int")
    got = {}
    for r in retrieval.diversified(df, "q", "paper", "id", 2, 2).collect():
        got.setdefault(r["q"], set()).add(r["id"])
    for i, rows in cases.items():
        taken, papers = set(), {}
        for p, s, j in sorted(rows, key=lambda x: (-x[1], x[2])):
            if papers.get(p, 0) >= 2:
                continue
            taken.add(j)
            papers[p] = papers.get(p, 0) + 1
            if len(papers) >= 2 and len(taken) >= 12:
                break
        assert got[i] == taken


def test_packing_is_the_loop(spark):
    rng = random.Random(4)
    cases = {i: [(a, b, rng.randint(1, 60)) for a in range(6) for b in range(rng.randint(1, 4))] for i in range(40)}
    df = spark.createDataFrame([(i, *r) for i, rows in cases.items() for r in rows], "key int, ref_no int, chunk_no int, n int")
    got = {}
    for r in ranking.packed(df, "key", 150).collect():
        got.setdefault(r["key"], []).append((r["ref_no"], r["chunk_no"], r["n"]))
    for i, rows in cases.items():
        taken, total = [], 0
        for ref in range(6):
            for r in [r for r in rows if r[0] == ref]:
                if total + r[2] > 150:
                    break
                taken.append(r)
                total += r[2]
            if total >= 150:
                break
        assert sorted(got.get(i, [])) == taken


def test_citations(spark):
    kept = text.citations_kept(F.col("a"), F.array(F.lit("ref_1"), F.lit("ref_2")))
    assert one(spark, kept, a="x [ref_1, ref_99] y [ref_7]  z") == "x [ref_1] y z"
    names = ["Ann Lee", "Bob Ray", "Cy Young"]
    who = citations.author_list(F.col("a"))
    assert one(spark, who, a=names) == "Ann Lee, Bob Ray, Cy Young"
    assert one(spark, who, a=[*names, "Dan Roe"]) == "Ann Lee, Bob Ray, Cy Young, et al"
    assert one(spark, text.doi_of(F.col("a")), a="https://doi.org/10.1093/abc/def/123.") == "10.1093/abc/def"
    assert one(spark, text.doi_of(F.col("a")), a=None) == ""


@pytest.mark.parametrize("v, tier", [(None, "unknown"), (0.99, "below-sucrose"), (1.0, "low"), (9.99, "low"), (10.0, "medium"), (1000.0, "medium"), (1000.01, "high")])
def test_tiers(spark, v, tier):
    assert spark.createDataFrame([(v,)], "a double").select(numbers.sweetness_tier(F.col("a"))).first()[0] == tier


@pytest.mark.parametrize(
    "path, want",
    [("/srv/app/library/x/a.pdf", "library/x/a.pdf"), ("library/x/a.pdf", "library/x/a.pdf"), ("/other/box/old_sweet/a.pdf", "library/sweetness/a.pdf"), ("library\\x\\a.pdf", "library/x/a.pdf"), ("/nowhere/b.pdf", "b.pdf"), ("", "")],
)
def test_paths(spark, path, want):
    assert one(spark, paths.canonical(F.col("p"), "/srv/app"), p=path) == want


def test_questions(spark):
    assert queries.INDEX["glucose"] == "糖尿病"
    assert one(spark, queries.topic_tokens(F.col("q")), q="如何比较 stevia 与 T1R2 的作用") == sorted({"比较", "stevia", "t1r2"} - {"作用"})
    assert one(spark, F.size(queries.variants(F.col("e"), F.col("q"))), e="a OR b", q="sweet receptor binding") == 5
    assert one(spark, queries.complexity(F.col("q")), q="") == 0


def test_fuzzy_names_and_null_order(spark):
    rows = spark.createDataFrame([(1, "Sugar", 2.0), (2, "Salt", None), (3, "Sugar cane", 1.0)], "id bigint, name string, v double")
    best = compounds.fuzzy(rows, "id", ["name"], "Sugr", limit=2).collect()
    assert best[0]["id"] == 1 and best[0]["score"] > 60
    for down in (True, False):
        assert [r["id"] for r in rows.orderBy(compounds.ordered(F.col("v"), down)).collect()][-1] == 2


def test_curation(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(curation.upserted(old, new, ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(curation.upserted(old, new, ["id"], "ignore")) == [(1, "a"), (2, "b"), (3, "d")]
    with pytest.raises(ValueError, match="outside"):
        curation.conformed(old, curation.MOLECULES)
    same = spark.createDataFrame([(1, None), (1, None), (2, "x")], "id int, v string")
    assert curation.first_by_key(same, ["id"], [F.col("v")]).count() == 2
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1)], "u int, v int")
    assert rows(curation.groups_of(edges)) == [(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]


def test_index_integrity(spark):
    rows = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0])], "vec_id bigint, v array<double>")
    found = {r["violation"]: r["n"] for r in checks.index_report(vectors, rows, "vec_id", "doc_id", "v", 2).collect()}
    assert found == {"repeated ids": 1, "without vector": 1, "wrong dimension": 1}


def test_splits_are_exact_and_disjoint(spark):
    rows = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "id bigint, y int")
    n = {(r["y"], r["split"]): r["count"] for r in ml.stratified(rows, "id", "y").groupBy("y", "split").count().collect()}
    assert n == {(1, "train"): 70, (1, "val"): 15, (1, "test"): 15, (0, "train"): 210, (0, "val"): 45, (0, "test"): 45}
    assert ml.permuted(rows, "id", "y", 3).agg(F.sum("y")).first()[0] == 100


def test_best_threshold_defaults(spark):
    none = spark.createDataFrame([(0, 0.4), (0, 0.9)], "y int, p double")
    assert tuple(metrics.best_threshold(none, "y", "p").first()) == (50, 0.0)
    some = spark.createDataFrame([(1, 0.45), (0, 0.35), (1, 0.6)], "y int, p double")
    assert tuple(metrics.best_threshold(some, "y", "p").first()) == (36, 1.0)


def test_jobs(spark):
    log = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "docking"), ("b", 1, "queued"), ("c", 1, "complete")], "job string, at int, status string").withColumn("ts", F.timestamp_seconds("at"))
    now = jobs.latest(log, "job", "ts", "status")
    assert {r["job"]: r["status"] for r in now.collect()} == {"a": "docking", "b": "queued", "c": "complete"}
    late = jobs.expired(now, F.timestamp_seconds(F.lit(10**6)))
    assert {r["job"]: r["status"] for r in late.collect()} == {"a": "docking", "b": "expired", "c": "expired"}
    assert {r["job"]: r["status"] for r in jobs.recovered(now).collect()} == {"a": "failed", "b": "queued", "c": "complete"}
    assert jobs.next_queued(now).first()["job"] == "b"


def test_event_bodies(spark):
    df = spark.createDataFrame([(1, "event: status\ndata: a\ndata: b\n\ndata: {}\n\n")], "id int, body string")
    assert [tuple(r) for r in jobs.sse_events(df, "id", "body").collect()] == [(1, 0, "status", "a\nb"), (1, 1, "message", "{}")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, i // 10) for i in range(100)], "id bigint, at bigint").withColumn("ts", F.timestamp_seconds(F.col("at") * 60 + 1_700_000_000))
    rows.write.parquet(f"{tmp_path}/in")
    streams.ingest(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    rows.limit(5).write.mode("append").parquet(f"{tmp_path}/in")
    streams.ingest(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 105
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    seen = []
    streams.to_sink(streams.event_windows(stream, "ts", "1 minute", "5 minutes"), f"{tmp_path}/c2", lambda df, n: seen.extend(df.collect()), "complete").awaitTermination()
    assert sum(r["n"] for r in seen) == 105
    seen.clear()
    streams.to_sink(streams.distinct_events(stream, "ts", "1 hour", "id"), f"{tmp_path}/c3", lambda df, n: seen.extend(df.collect())).awaitTermination()
    assert len(seen) == 100
    seen.clear()
    streams.to_sink(streams.sessions(stream, "ts", "1 minute", "2 minutes", "at"), f"{tmp_path}/c4", lambda df, n: seen.extend(df.collect()), "complete").awaitTermination()
    assert sum(r["n"] for r in seen) == 105


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("hello\nworld")
    (tmp_path / "a/y.pdf").write_bytes(b"no pdf")
    (tmp_path / "a/z.md").write_text("too long by far")
    (tmp_path / "list.txt").write_text("# no\n\n one \none\ntwo")
    (tmp_path / "gold.json").write_text('{"questions": [{"id": "q1"}, {"id": "q2"}]}')
    (tmp_path / "map.json").write_text('{"k": {"v": 1}, "s": "{\\"v\\": 2}"}')
    (tmp_path / "t.csv").write_text("id,v\n007,1\n008,x\n")
    root = str(tmp_path)
    assert files.listing(spark, f"{root}/a", [".txt", ".md"]).count() == 2
    assert {(r["path"].rpartition("/")[2], r["reason"]) for r in files.checked(spark, f"{root}/a", most=12).collect()} == {("x.txt", None), ("y.pdf", "no pdf mark"), ("z.md", "too large")}
    assert {r["text"] for r in files.whole_texts(spark, f"{root}/a/x.txt").collect()} == {"hello\nworld"}
    assert {r["line"] for r in files.focus_list(spark, f"{root}/list.txt").collect()} == {"one", "two"}
    from pyspark.sql import types as T

    item = T.StructType.fromDDL("id string")
    assert [r["id"] for r in files.json_list(spark, f"{root}/gold.json", "questions", item).collect()] == ["q1", "q2"]
    assert {(r["key"], r["value"]["v"]) for r in files.json_map(spark, f"{root}/map.json", T.StructType.fromDDL("v int")).collect()} == {("k", 1), ("s", 2)}
    typed = files.csv_table(spark, f"{root}/t.csv", T.StructType.fromDDL("id string, v int"))
    assert [tuple(r) for r in typed.collect()] == [("007", 1), ("008", None)]
    df = spark.range(3)
    files.publish(df, f"{root}/rel", "1")
    files.publish(df.limit(2), f"{root}/rel", "2")
    assert files.current(spark, f"{root}/rel").count() == 2
    with pytest.raises(ValueError, match="breaks"):
        files.publish(df, f"{root}/rel", "3", [lambda x: x.where("id = 1")])
    assert files.current(spark, f"{root}/rel").count() == 2
    assert files.with_fallback(spark.read.parquet, f"{root}/missing", f"{root}/rel/version=1").count() == 3
    files.sheets({"one": df, "two": df}, f"{root}/book", "csv")
    assert spark.read.option("header", True).csv(f"{root}/book/two").count() == 3
    with pytest.raises(PermissionError):
        files.ReadOnly(df).upsert(df)


def test_boundaries(spark):
    from quern.sources import boundaries

    rows = spark.createDataFrame([(1, "CCO"), (2, "bad"), (3, None)], "id int, smiles string")

    def load():
        def fn(s):
            if s == "bad":
                raise ValueError(s)
            return {"canonical": s, "key": s.lower(), "mass": 46.07, "atoms": 3}

        return fn

    got = {r["id"]: (r["standard"]["valid"], r["standard"]["reason"]) for r in boundaries.standardised(rows, "smiles", load).collect()}
    assert got == {1: (True, None), 2: (False, "ValueError"), 3: (False, "empty")}
    found, missing = boundaries.cached_lookup(rows, spark.createDataFrame([("cco", "ethanol")], "smiles string, name string"), "smiles")
    assert found.count() == 3 and [r["smiles"] for r in missing.collect()] == ["bad"]


def test_models_are_saved(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import RandomForestClassifier

    rows = spark.createDataFrame([(float(i), i % 2) for i in range(40)], "x double, y int")
    data = ml.assembled(rows, ["x"], "y")
    Pipeline(stages=[RandomForestClassifier(numTrees=2, seed=1)]).fit(data).write().overwrite().save(f"{tmp_path}/model")
    assert PipelineModel.load(f"{tmp_path}/model").transform(data).count() == 40


def test_domains_load_once(spark):
    import threading

    from quern.operators.runtime import Domains

    calls = []

    def load():
        calls.append(1)
        return spark.range(2)

    def fail():
        raise OSError("no index")

    domains = Domains({"a": load, "b": fail, "c": lambda: None, "d": load})
    threads = [threading.Thread(target=domains.get, args=("a",)) for _ in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(calls) == 1
    for name, error in (("b", OSError), ("c", LookupError)):
        with pytest.raises(error):
            domains.get(name)
    assert {r["domain"]: r["state"] for r in domains.snapshot(spark).collect()} == {"a": "ready", "b": "failed", "c": "not_built", "d": "not_loaded"}


def test_ranks_and_quantiles_over_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]) if i % 4 else "a", rng.choice([None, rng.randint(0, 30) / 4])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(7)
    found = ranges.ranked(df, ["g"], [F.desc_nulls_last("v"), F.col("id").asc()], "place").collect()
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [(r["id"], r["place"], r["all_place"]) for r in sorted(found, key=lambda r: r["place"]) if r["g"] == g] == [(r[0], k + 1, len(own)) for k, r in enumerate(own)]
    for r in ranges.quantiles(df, ["g"], "v", {"low": 0.25, "mid": 0.5, "top": 1.0}).collect():
        own = sorted(x[2] for x in rows if x[1] == r["g"] and x[2] is not None)
        at = lambda p: own[int((len(own) - 1) * p)] + (own[min(len(own) - 1, int((len(own) - 1) * p) + 1)] - own[int((len(own) - 1) * p)]) * ((len(own) - 1) * p % 1)
        assert abs(r["low"] - at(0.25)) < 1e-9 and abs(r["mid"] - at(0.5)) < 1e-9 and r["top"] == own[-1]
    assert ranges.quantiles(df.where("false"), ["g"], "v", {"mid": 0.5}).count() == 0


def test_exact_areas(spark):
    rng = random.Random(4)
    rows = [(rng.random() / 1e7, int(rng.random() < 0.4)) for _ in range(300)] + [(0.5, 1), (0.5, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(df, "y", "s").first()[0] - area) < 1e-9


def test_titles_as_brute_force(spark):
    from difflib import SequenceMatcher

    rng = random.Random(5)
    words = ["sweet", "receptor", "binding", "a", "review", "of", "the", "effects", "effect", "in", "rats", "taste"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["a review of sweet receptor binding", "effects of taste in rats", "A", "ab", "abcde", "Sweet"]

    def changed(t):
        at = rng.randrange(len(t))
        return rng.choice([t, t[:at] + t[at + 1 :], t[:at] + "x" + t[at:], t[:at] + "y" + t[at + 1 :], t.partition(" ")[2] or t, t.upper()])

    others = [changed(t) for t in titles] + ["review of sweet receptor binding", "effect of taste in rats", "abcdf"]
    rows = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    found = {r["id"]: (r["match"], round(r["ratio"], 9)) for r in compounds.best_titles(rows, spark.createDataFrame([(t,) for t in others], "title string"), "id", "title").collect()}
    for i, t in enumerate(titles):
        best = max((SequenceMatcher(None, t.lower(), o.lower()).ratio(), o.lower()) for o in others)
        if best[0] >= 0.9:
            assert found[i][1] == round(best[0], 9) and SequenceMatcher(None, t.lower(), found[i][0].lower()).ratio() == best[0], (t, best, found.get(i))
        else:
            assert i not in found
    assert sum(1 for i in found if titles[i].lower() != found[i][0].lower()) > 10


def test_token_sets(spark):
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert compounds.common_letters(a, b) == row[-1]
    assert compounds.token_set_ratio("Red widget", "widget, red!") == 100 and compounds.token_set_ratio("", "a") == 0
    assert compounds.token_set_ratio("red wigdet", "red widget") == 90
    rows = spark.createDataFrame([(i, "red widget" if i > 3 else "blue", "red") for i in range(30)], "id int, a string, b string")
    best = compounds.fuzzy(rows, "id", ["a", "b"], "red widget", limit=5, least=60).collect()
    assert [(r["id"], r["column"]) for r in best] == [(i, "a") for i in range(4, 9)]


def test_chemical_space_keeps_what_two_axes_can(spark):
    rng = random.Random(7)
    near, far = (1 << 40) - 1, ((1 << 20) - 1) << 42
    rows = [(i, [(near if i % 2 else far) & ~(1 << rng.randrange(62))]) for i in range(90)]
    found = {r["id"]: (r["x"], r["y"]) for r in compounds.chemical_space(spark.createDataFrame(rows, "id bigint, words array<bigint>"), "id", "words").collect()}
    assert len(found) == 90
    sides = [{found[i][0] > 0.5 for i in range(k, 90, 2)} for k in (0, 1)]
    assert len(sides[0]) == len(sides[1]) == 1 and sides[0] != sides[1]
    for n in (0, 1, 2):
        assert compounds.chemical_space(spark.createDataFrame(rows[:n], "id bigint, words array<bigint>"), "id", "words").count() == n


def test_release_report_digests_and_guards(spark, tmp_path):
    import hashlib

    from quern.operators import checks

    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    vectors, chunks = make([(1,), (2,)], "id int"), make([("a", 1), ("b", 2)], "c string, id int")
    report = lambda chunks, *m: {r["rule"]: r["holds"] for r in checks.release_report(vectors, chunks, make([m], "vector_count int, chunk_count int, orphan_vector_count int, vectors_seen int"), "id", "id").collect()}
    assert all(report(chunks, 2, 2, 1, 3).values()) and all(report(chunks, 2, 2, None, None).values())
    assert [k for k, v in report(chunks, 1, 2, 0, 2).items() if not v] == ["manifest vectors"]
    assert not report(make([("a", 1), ("b", None)], "c string, id int"), 2, 2, 0, 2)["vectors = mapped = chunks"]
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert [tuple(r) for r in files.digests(spark, str(tmp_path)).collect()] == [("x.bin", hashlib.sha256(b"abc").hexdigest())]
    files.guard(spark, str(tmp_path), 0.0, 1e6)
    for limits in ((1e9, 1e6), (0.0, 1e-6)):
        with pytest.raises(RuntimeError):
            files.guard(spark, str(tmp_path), *limits)


def test_a_broken_publish_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "rel")
    with pytest.raises(FileNotFoundError):
        files.current(spark, root)
    files.publish(spark.range(3), root, "1")
    (tmp_path / "rel" / "pointers" / ".half").write_text("{")  # a publisher that stopped before its rename
    assert files.current(spark, root).count() == 3
    files.publish(spark.range(5), root, "2")
    assert files.current(spark, root).count() == 5


def test_sentence_chunks_as_the_loop(spark):
    import re

    rng = random.Random(8)
    texts = ["".join(rng.choice(["one two", "a", "long words here", " ", "\n\n", "\n", ".", ",", "。", "; ", "x " * 12]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", " \n\n ", "w " * 45]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", text.sentence_chunks(F.col("t"), 10, 4).alias("c")).collect()
    for r in found:
        parts = []
        for p in texts[r["i"]].split("\n\n"):
            for s in re.findall(r"[^,.;。？！]+[,.;。？！]?|[,.;。？！]", p):
                w = s.split()
                parts += [w[k : k + 10] for k in range(0, len(w), 10)]
        done, open_ = [], []
        for w in parts:
            if sum(map(len, open_)) + len(w) > 10:
                done.append(open_)
                again = []
                for x in reversed(open_):
                    if sum(map(len, again)) + len(x) > min(4, 10 - len(w)):
                        break
                    again.insert(0, x)
                open_ = again
            open_ = [*open_, w]
        want = [" ".join(w for s in ch for w in s) for ch in [*done, open_] if ch]
        assert r["c"] == want, texts[r["i"]]
        assert all(len(ch.split()) <= 10 for ch in r["c"])


def test_kept_copies_as_the_rule(spark):
    import re
    from difflib import SequenceMatcher

    rows = [
        ("a", "x/Sweet taste (2).pdf", "Sweet taste", 9, 10), ("a", "x/1-s2.0-S0.pdf", "Sweet taste", 9, 99), ("a", "x/Sweet taste.pdf", "Sweet taste!", 9, 5), ("a", "x/Lee - 2001 - Sweet.pdf", "Sweet taste", 9, 5),
        ("b", "x/p copy.pdf", None, 7, 1), ("b", "x/q.pdf", None, 3, 1), ("b", "x/r.pdf", None, 3, 1), ("c", "x/s - 1999 - t.pdf", "", 1, 1), ("c", "x/t.pdf", "", 1, 1),
    ]

    def rank(path, title, pages, size):
        stem = path.rpartition("/")[2].rpartition(".")[0]
        key = lambda x: re.sub("[^a-z0-9]+", "", x.lower())
        mark = re.compile(curation.COPY_MARK)
        like = SequenceMatcher(None, key(mark.sub("", stem)), key(title)).ratio() if key(title or "") else 0.0
        return (not mark.search(stem), pages, not stem.lower().startswith("1-s2.0-"), like, bool(re.search(curation.DATED, stem)), size)

    found = {r["g"]: r["kept"] for r in curation.kept_copies(spark.createDataFrame(rows, "g string, path string, title string, pages int, size int"), "g", "path", "title", "pages", "size").collect()}
    for g in "abc":
        own = [r[1:] for r in rows if r[0] == g]
        best = max(rank(*r) for r in own)
        assert found[g] == min(r[0] for r in own if rank(*r) == best)
    assert found["a"] == "x/Sweet taste.pdf" and found["c"] == "x/s - 1999 - t.pdf"


def test_catalog_text_with_unicode(spark):
    import html
    import re
    import unicodedata

    texts = ["Ｆｕｌｌ ｗｉｄｔｈ &amp; <i>x</i>", "ﬁne &#945;-D  \u00a0glucose", None, "n/a", "&lt;b&gt;kept&lt;/b&gt;", "a\u2003b\tc", "Unknown Title", "½ &frac12;"]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.catalog_text(F.col("t")).alias("c")).collect()
    for r in found:
        t = html.unescape(unicodedata.normalize("NFKC", texts[r["i"]] or ""))
        t = re.sub(r"\s+", " ", re.sub("<[^>]+>", "", t)).strip()
        assert r["c"] == ("" if t.lower() in text.MISSING else t)
