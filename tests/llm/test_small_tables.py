"""Every operator and stage on empty tables, nulls, empty and long texts, repeated rows and extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chat, decontaminate, fingerprints, language, licenses, mixing, neardup, pii, toxicity, urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, rep int"
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "a plain text about nothing", "en", "a", 26, None, None, 1),
    (1, "a plain text about nothing", "en", "a", 26, None, None, 1),
    (2, None, None, None, None, 0.5, "x", None),
    (3, "", "fr", "b", 0, None, None, None),
    (None, "no id here", "en", "b", 10, None, None, 2),
    (4, LONG, "la", "c", len(LONG), None, None, 3),
    (5, "  \t\n ", "en", "c", 5, None, None, 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 0, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


def test_language(docs, none):
    for df, n in ((docs, 7), (none, 0)):
        found = language.predict(df, language.fit(df, F.lit(True))).collect()
        assert len(found) == n
        for r in found:
            assert 0 <= r["score"] <= 1
            if not r["text"] or not r["text"].strip():
                assert r["lang_pred"] == "und" and r["score"] == 0


def test_toxicity(docs, none, labels):
    for df, n in ((docs, 7), (none, 0)):
        found = toxicity.score(df, toxicity.fit(df, labels, F.lit(True))).collect()
        assert len(found) == n and all(0 <= r["score"] <= 1 for r in found)


def test_near_duplicates(docs, none):
    assert neardup.groups(none).collect() == []
    found = neardup.groups(docs, 2).collect()
    assert len(found) == 7
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert by_id[2]["n_shingles"] == 0 and by_id[2]["component_id"] == 2
    assert by_id[3]["kept"] and by_id[5]["kept"]


def test_fingerprints(docs, none):
    assert fingerprints.edit_likeness(none).collect() == []
    found = fingerprints.edit_likeness(docs).collect()
    assert len(found) == 7
    prints = fingerprints.fingerprinted(docs)
    assert {r["fingerprint"] for r in prints.where("coalesce(trim(text), '') = ''").collect()} >= {0}
    assert fingerprints.within(prints.where("doc_id = 1"), prints).where("distance = 0").first()["copies"] == 2


def test_personal_data(docs, none):
    for df, n in ((docs, 7), (none, 0)):
        found = pii.labelled(df)
        model = pii.fit(found)
        assert pii.decided(found, model).count() == n
        assert pii.redacted(pii.labelled(df), model).columns == df.columns


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "a plain text about nothing"), (2, None), (None, "x y z a b c d e"), (3, ""), (4, "two words")], "item_id bigint, text string")
    held = decontaminate.leaks(docs, bench).collect()
    assert [(r["item_id"], r["share"]) for r in held] == [(1, 1.0)]
    assert decontaminate.clean(docs, bench).count() == 5
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == 7


def test_mixing(docs, none):
    assert mixing.mix(none).collect() == []
    found = mixing.mix(docs).collect()
    assert len(found) == 7 and all(0 <= r["taken"] <= 2 * r["size"] for r in found)


def test_licenses(docs, none):
    assert licenses.scan(none).collect() == []
    assert all(r["licenses"] == [] for r in licenses.scan(docs).collect())


def test_chat(spark):
    kind = "tree bigint, node bigint, parent bigint, score double, role string, text string, rank int"
    assert chat.formatted(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, 1, None, None, None, None, 0), (1, 1, None, None, None, None, 0), (1, 2, 9, 1.0, "user", "", 0), (None, 1, None, 0.0, "user", "x", 0), (2, 1, 2, 0.0, "a", "b", 0), (2, 2, 1, 0.0, "a", "b", 0)]
    found = chat.formatted(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r["tree"], r["leaf"], r["n_turns"]) for r in found) == [(1, 1, 1), (1, 2, 1)]


def test_urls(spark):
    rules = spark.createDataFrame(urls.RULES + [(None, "/", "block"), ("x", None, "allow"), ("", "/", "block")], "host string, path string, verdict string")
    kind = "page_id bigint, url string, host string, rule string"
    rows = [(1, None, "h", "r"), (1, None, "h", "r"), (2, "", "h", "r"), (None, "http://a.com/en/", "h", "r"), (3, "http://EXAMPLE.com/en/x?q", "h", "r"), (4, "no scheme", "h", "r"), (5, "http://www.example.com/en/", "h", "r"), (6, "http://x.com", "", "")]
    for most in (10, 0):
        found = urls.judge(spark.createDataFrame(rows, kind), rules, broadcast_rules=most).collect()
        assert sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in found) == [
            (0, "a.com", "/en/", "com/", "allow"), (1, "", "", "", "allow"), (1, "", "", "", "allow"), (2, "", "", "", "allow"),
            (3, "example.com", "/en/x", "example.com/en/", "block"), (4, "", "", "", "allow"),
            (5, "www.example.com", "/en/", "www.example.com/en/", "allow"), (6, "x.com", "", "", "allow"),
        ]
    assert urls.judge(spark.createDataFrame([], kind), rules).collect() == []
    assert urls.judge(spark.createDataFrame(rows, kind), rules.limit(0)).count() == 8


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, none, labels, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (docs, none):
        out = corpus_pipeline.STAGES[stage][1](spark, df, str(tmp_path))
        assert set(out.columns) >= set(df.columns) if stage == 4 else out.columns == df.columns
        assert out.count() <= df.count()


CLASHES = "licenses lang_pred fingerprint candidates spans _candidates _merged _row _text _spans _cut text_key code bits _held _toxicity taken target source_size _draw _no _shard _id _key id n least row rank".split()


def test_clashing_names(spark, docs, labels, tmp_path):
    """Columns with the names that an operator uses inside or puts out: outputs replace theirs, the rest come through unchanged."""
    wide = docs.drop("rep", "score", "size").withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    rest = lambda df, *out: [c for c in CLASHES if c not in out and c in df.columns]

    def same(df, *out, n=7):
        rows = df.collect()
        assert set(wide.columns) - set(out) <= set(df.columns) and len(rows) == n
        assert all(r[c] == f"own {c}" for r in rows for c in rest(df, *out))

    same(licenses.scan(wide), "licenses")
    same(language.predict(wide, language.fit(wide, F.lit(True))), "lang_pred")
    same(fingerprints.fingerprinted(wide), "fingerprint")
    same(toxicity.score(wide, toxicity.fit(wide, labels, F.lit(True))))
    found = pii.labelled(wide)
    same(found, "candidates")
    same(pii.decided(found, pii.Model()), "candidates", "spans")
    same(pii.redacted(found, pii.Model()), "candidates")
    same(mixing.mixed(wide), "source_size", "target", "taken")
    assert mixing.mix(wide).count() == neardup.groups(wide).count() == fingerprints.edit_likeness(wide).count() == 7
    bench = spark.createDataFrame([(1, "a plain text about nothing")], "item_id bigint, text string")
    same(decontaminate.clean(wide, bench), n=5)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, str(tmp_path))
        assert all(r[c] == f"own {c}" for r in out.collect() for c in rest(out, "source_size", "target", "taken")), name


def test_ties(spark):
    """Languages of equal cosine go to the first name; rows of one id and text have one fingerprint and follow each other."""
    rows = [(1, "abc abc", "b"), (2, "abc abc", "a"), (3, "abc abc", "b"), (4, "abc abc", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in language.predict(df, language.fit(df, F.lit(True))).collect()} == {"a"}
    same = spark.createDataFrame([(1, "one two three four")] * 3 + [(2, "five")], "doc_id bigint, text string")
    found = sorted((r["doc_id"], r["near_next"]) for r in fingerprints.edit_likeness(same).collect())
    assert [f[0] for f in found] == [1, 1, 1, 2] and [f[1] for f in found].count(1.0) == 2


def test_a_benchmark_of_short_items(spark, docs):
    bench = spark.createDataFrame([(1, "nothing"), (1, "nothing"), (1, "ipsum dolor"), (2, "absent"), (3, "!!"), (4, "12")], "item_id bigint, text string")
    text = docs.where("text is not null").select("text").distinct().withColumn("k", decontaminate.text_key(F.col("text")))
    held = decontaminate.leaks(docs, bench).join(text, F.col("k") == F.col("text_key")).collect()
    assert sorted((r["item_id"], r["text"][:5], r["share"]) for r in held) == [(1, "a pla", 1.0), (1, "lorem", 1.0)]


def test_scratch_tables_are_released(spark, docs):
    from quern.llm import scratch

    before = spark.conf.get("spark.checkpoint.dir")
    since = scratch.mark()
    assert mixing.mix(docs).count() == 7 and scratch.mark() > since
    scratch.release(since)
    assert scratch.mark() == since and spark.conf.get("spark.checkpoint.dir") == before
