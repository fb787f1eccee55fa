"""Queries of measures, gates, splits and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.numbers import rounded
from quern.operators import attributions, checks, containment, curation, metrics, ml, ranges
from quern.plans.base import Tables, query
from quern.plans.proxies import ANSWERS
from quern.plans.retrieval import _HITS, hits

_EXPECTED = "x AS (SELECT a.vec_id AS query_id, b.vec_id AS item, CASE WHEN b.embedding[1] > 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS relevance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.label = b.label)"


@query("e6_e7_e8_ranked_measures", f"""WITH {_HITS.format(k=40)}, {_EXPECTED}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, item) AS ir FROM x), j AS (SELECT x.*, h.rank FROM x LEFT JOIN hits h ON h.query_id = x.query_id AND h.vec_id = x.item)
SELECT j.query_id, count(rank) FILTER (rank <= 20) / count(*) AS recall, coalesce(1.0 / min(rank), 0.0)::DOUBLE AS rr,
round(coalesce(sum((pow(2, relevance) - 1) / log2(rank + 1)) FILTER (rank <= 20), 0) / (SELECT sum((pow(2, relevance) - 1) / log2(ir + 1)) FROM i WHERE i.query_id = j.query_id AND ir <= 20), 6) AS ndcg FROM j GROUP BY j.query_id""")
def e6(t: Tables) -> DataFrame:
    """All vectors of a query's label count as relevant, by a grade from the vector itself; grades are counted by label, so no query meets all of them."""
    items = t.embeddings.select(F.col("vec_id").alias("item"), F.col("label").alias("theirs"), F.when(F.get("embedding", 0) > 0, 3.0).otherwise(1.0).alias("relevance"))
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    found = hits(t, 40).select("query_id", F.col("vec_id").alias("item"), "rank").join(items, "item").join(asked, "query_id")
    graded = found.select("query_id", "rank", F.when(F.col("theirs") == F.col("own"), F.col("relevance")).alias("relevance"))
    counts = asked.join(items.groupBy(F.col("theirs").alias("own"), "relevance").agg(F.count("*").alias("n")), "own").select("query_id", "relevance", "n")
    return metrics.graded_measures(graded, counts, 20).withColumn("ndcg", F.round("ndcg", 6))


@query("e8_quote_recall", "SELECT item_id, count(doc_id) AS found FROM benchmark LEFT JOIN documents ON contains(lower(regexp_replace(documents.text, '\\s+', '', 'g')), lower(regexp_replace(benchmark.text, '\\s+', '', 'g'))) GROUP BY item_id")
def e8(t: Tables) -> DataFrame:
    quotes = t.benchmark.select("item_id", text.strip_space(F.col("text")).alias("quote"))
    docs = t.documents.select("doc_id", text.strip_space(F.col("text")).alias("body"))
    found = containment.containing(docs, "body", quotes, "quote").groupBy("item_id").agg(F.count("*").alias("n"))
    return quotes.join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("found"))


_SCORED = "s AS (SELECT o_orderkey AS id, (o_orderstatus = 'F')::INT AS y, round((o_totalprice % 1000) / 1000, 3) AS p FROM orders WHERE o_orderstatus IN ('F', 'O'))"


def scored(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), rounded((F.col("o_totalprice") % 1000) / 1000, 3).alias("p"))


@query("d13_confusion", f"WITH {_SCORED}, c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM s) SELECT *, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c")
def d13(t: Tables) -> DataFrame:
    out = metrics.confusion(F.col("y"), F.col("p") >= 0.5)
    return scored(t).agg(*[(c if k in ("tp", "fp", "fn", "tn") else F.round(c, 9)).alias(k) for k, c in out.items()])


@query("k8_threshold_scan", f"WITH {_SCORED}, g AS (SELECT unnest(range(30, 71)) AS th), f AS (SELECT th, count(*) FILTER (y = 1 AND round(p * 100, 6) >= th) AS tp, count(*) FILTER (y = 0 AND round(p * 100, 6) >= th) AS fp, count(*) FILTER (y = 1 AND round(p * 100, 6) < th) AS fn FROM s, g GROUP BY th) SELECT th::INT AS threshold, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM f ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, th LIMIT 1")
def k8(t: Tables) -> DataFrame:
    return metrics.best_threshold(scored(t), "y", "p").withColumn("f1", F.round("f1", 9))


@query("e9_roc_auc", f"WITH {_SCORED}, r AS (SELECT y, avg(rn) OVER (PARTITION BY p) AS r FROM (SELECT *, row_number() OVER (ORDER BY p) AS rn FROM s)) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS roc_auc FROM r")
def e9(t: Tables) -> DataFrame:
    return metrics.roc_auc(scored(t), "y", "p").withColumn("roc_auc", F.round("roc_auc", 9))


@query("e9_roc_curve", f"WITH {_SCORED}, b AS (SELECT p, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS n FROM s GROUP BY p) SELECT p AS threshold, sum(a) OVER w::BIGINT AS tp, sum(n) OVER w::BIGINT AS fp FROM b WINDOW w AS (ORDER BY p DESC)".replace("sum(a) OVER w::BIGINT", "(sum(a) OVER w)::BIGINT").replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT"))
def e9c(t: Tables) -> DataFrame:
    return metrics.curve(scored(t), "y", "p").select("threshold", "tp", "fp")


@query("e10_average_precision", f"WITH {_SCORED}, b AS (SELECT p, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS n FROM s GROUP BY p), c AS (SELECT p, a, sum(a) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS fp, sum(a) OVER () AS total FROM b) SELECT round(sum(a / total * (tp / (tp + fp))), 9) AS average_precision FROM c")
def e10(t: Tables) -> DataFrame:
    return metrics.average_precision(scored(t), "y", "p").withColumn("average_precision", F.round("average_precision", 9))


@query("e11_rank", "WITH m AS (SELECT p_type, p_brand, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY p_type ORDER BY mean DESC) AS place FROM m")
def e11(t: Tables) -> DataFrame:
    means = t.part.groupBy("p_type", "p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"))
    return means.withColumn("place", F.rank().over(Window.partitionBy("p_type").orderBy(F.desc("mean"))).cast("bigint"))


@query("e12_j22_review_packet", "WITH a AS (SELECT source, doc_id, lang, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS best FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM a WHERE best = 1) SELECT source, doc_id, k FROM b WHERE k <= 3")
def e12(t: Tables) -> DataFrame:
    best = Window.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id")
    one = t.documents.select("source", "lang", "doc_id", "n_chars").withColumn("b", F.row_number().over(best)).where("b = 1")
    return one.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("bigint")).where("k <= 3").select("source", "doc_id", "k")


@query("e16_history", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, role, left(trim(text, ' '), 2400) AS content FROM r WHERE k <= 6 AND role IN ('user', 'assistant') AND trim(text, ' ') <> ''")
def e16(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = t.conversations.withColumn("k", F.row_number().over(w)).where("k <= 6").where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return last.select("conv_id", "turn", "role", F.left(F.trim("text"), F.lit(2400)).alias("content"))


@query("d9_d10_d11_latency", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(coalesce(stddev_pop(value), 0), 6) AS sd FROM events GROUP BY event_type")
def d10(t: Tables) -> DataFrame:
    v = F.col("value")
    means = t.events.groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop(v), F.lit(0.0)), 6).alias("sd"))
    ranks = ranges.quantiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    at = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return means.join(ranks, "event_type", "left").select("event_type", "mean", at("p50"), at("p95"), "sd")


@query("d8_question_counts", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS approved, count(*) FILTER (n_chars > 1000) / count(*) AS rate FROM documents GROUP BY lang")
def d8(t: Tables) -> DataFrame:
    ok = F.col("n_chars") > 1000
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(ok).alias("approved"), (F.count_if(ok) / F.count("*")).alias("rate"))


@query("d12_refusal", f"WITH a AS (SELECT kind IN (1, 5) AS want, (contains(lower(answer), 'cannot answer') OR contains(answer, '证据不足')) AS got FROM ({ANSWERS})), c AS (SELECT count(*) FILTER (want AND got) AS b, count(*) FILTER (got) AS g, count(*) FILTER (want) AS w FROM a) SELECT round(b / g, 9) AS precision, round(b / w, 9) AS recall, round(2 * (b / g) * (b / w) / (b / g + b / w), 9) AS f1 FROM c")
def d12(t: Tables) -> DataFrame:
    out = metrics.refusals(F.col("kind").isin(1, 5), text.is_refusal(F.col("answer")))
    return t.sql(ANSWERS).agg(*[F.round(c, 9).alias(k) for k, c in out.items()])


@query("d14_rollup", f"WITH a AS (SELECT kind <> 3 AS ok, price, regexp_matches(answer, '\\[ref_\\d+') AS cited FROM ({ANSWERS})) SELECT round(avg(ok::INT), 9) AS success, round(sum(cited::INT) FILTER (ok) / greatest(count(*) FILTER (ok), 1), 9) AS citation_rate, round(avg(price) FILTER (ok), 4) AS mean_price FROM a")
def d14(t: Tables) -> DataFrame:
    ok, cited = F.col("kind") != 3, F.regexp_like("answer", F.lit(r"\[ref_\d+"))
    return t.sql(ANSWERS).agg(F.round(F.avg(ok.cast("int")), 9).alias("success"), F.round(F.count_if(ok & cited) / F.greatest(F.count_if(ok), F.lit(1)), 9).alias("citation_rate"), F.round(F.avg(F.when(ok, F.col("price"))), 4).alias("mean_price"))


@query("d15_trend_score", "WITH m AS (SELECT o_orderpriority AS g, avg(o_totalprice) / 1000000 AS retrieval, CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE 0.5 END::DOUBLE AS answer FROM orders GROUP BY g) SELECT g, round(retrieval * 60 + answer * 40, 6) AS score FROM m")
def d15(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.col("o_orderpriority").alias("g")).agg((F.avg("o_totalprice") / 1000000).alias("retrieval"))
    m = m.withColumn("answer", F.when(F.col("g") != "2-HIGH", 0.5))
    return m.select("g", F.round(metrics.weighted({"retrieval": 60.0, "answer": 40.0}), 6).alias("score"))


@query("d16_stability", "WITH g AS (SELECT user_id, event_type, stddev_pop(value) AS sd FROM events GROUP BY ALL HAVING count(*) >= 2) SELECT user_id, round(avg(sd), 6) AS stability FROM g GROUP BY user_id")
def d16(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id", "event_type").agg(F.stddev_pop("value").alias("sd"), F.count("*").alias("n")).where("n >= 2")
    return g.groupBy("user_id").agg(F.round(F.avg("sd"), 6).alias("stability"))


@query("d17_histogram", "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id")
def d17(t: Tables) -> DataFrame:
    kinds = ["view", "click", "purchase"]
    return t.events.where(F.col("event_type").isin(kinds)).groupBy("user_id").pivot("event_type", kinds).count().fillna(0, kinds)


@query("d22_regression", "WITH e AS (SELECT l_extendedprice AS a, l_quantity * 1500 AS p FROM lineitem) SELECT round(1 - avg((a - p) * (a - p)) / var_pop(a), 6) AS r2, round(avg(abs(a - p)), 4) AS mae, round(sqrt(avg((a - p) * (a - p))), 4) AS rmse, round(corr(a, p), 9) AS r FROM e")
def d22(t: Tables) -> DataFrame:
    out = metrics.regression(F.col("l_extendedprice"), F.col("l_quantity") * 1500)
    return t.lineitem.agg(*[F.round(c, {"r2": 6, "r": 9}.get(k, 4)).alias(k) for k, c in out.items()])


@query("c15_j24_baseline", "WITH a AS (SELECT user_id, avg(value) AS cur FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, avg(value) AS base FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT user_id, round(cur - base, 6) AS change, CASE WHEN cur < base - 0.05 THEN 'worse' WHEN cur > base + 5 THEN 'slower' ELSE 'same' END AS verdict FROM a JOIN b USING (user_id)")
def j24(t: Tables) -> DataFrame:
    side = lambda k, n: t.events.where(f"event_id % 2 = {k}").groupBy("user_id").agg(F.avg("value").alias(n))
    c, b = F.col("cur"), F.col("base")
    return side(0, "cur").join(side(1, "base"), "user_id").select("user_id", F.round(c - b, 6).alias("change"), F.when(c < b - 0.05, "worse").when(c > b + 5, "slower").otherwise("same").alias("verdict"))


_RUNS = "SELECT CASE CAST(n_nationkey AS INT) " + " ".join(f"WHEN {i} THEN '{m}'" for i, (m, *_) in enumerate(metrics.GATES)) + " END AS metric, CASE WHEN n_nationkey = 8 THEN NULL WHEN n_nationkey = 9 THEN 0.0 ELSE 0.9 + n_nationkey / 100.0 END AS current, CASE WHEN n_nationkey = 5 THEN NULL ELSE 0.92 END AS baseline FROM {nation} WHERE n_nationkey < 10"


@query("j23_release_gates", f"WITH r AS ({_RUNS}) SELECT metric, CASE metric WHEN 'document_recall_at_10' THEN current >= baseline WHEN 'evidence_recall_at_20' THEN current >= baseline WHEN 'mrr' THEN current >= baseline - 0.02 WHEN 'ndcg_at_10' THEN current >= baseline - 0.02 WHEN 'faithfulness' THEN current >= greatest(0.9, baseline - 0.02) WHEN 'citation_precision' THEN current >= 0.9 WHEN 'refusal_f1' THEN current >= 0.85 WHEN 'p95_latency_seconds' THEN current <= baseline * 1.2 WHEN 'avg_cost' THEN current <= baseline * 1.15 ELSE coalesce(current = 0, false) END AS passed FROM r")
def j23(t: Tables) -> DataFrame:
    return metrics.gates(t.sql(_RUNS).selectExpr("metric", "double(current) current", "double(baseline) baseline"))


_PASSED = "CASE metric WHEN 'document_recall_at_10' THEN current >= baseline WHEN 'evidence_recall_at_20' THEN current >= baseline WHEN 'mrr' THEN current >= baseline - 0.02 WHEN 'ndcg_at_10' THEN current >= baseline - 0.02 WHEN 'faithfulness' THEN current >= greatest(0.9, baseline - 0.02) WHEN 'citation_precision' THEN current >= 0.9 WHEN 'refusal_f1' THEN current >= 0.85 WHEN 'p95_latency_seconds' THEN current <= baseline * 1.2 WHEN 'avg_cost' THEN current <= baseline * 1.15 ELSE coalesce(current = 0, false) END"
#: One release a region: in one a metric is missing, in the others one is raised or lowered, so verdicts differ.
_RELEASES = "SELECT r_regionkey AS release, metric, CASE WHEN r_regionkey = 1 AND metric = 'mrr' THEN NULL WHEN r_regionkey = 2 AND metric = 'refusal_f1' THEN 0.5 WHEN metric IN ('p95_latency_seconds', 'avg_cost') THEN 1.0 WHEN metric = 'high_severity_hallucinations' THEN CAST(CASE WHEN r_regionkey = 3 THEN 1 ELSE 0 END AS DOUBLE) ELSE 0.95 END AS current, CASE WHEN r_regionkey = 4 THEN 0.96 ELSE 0.94 END AS baseline FROM {region} CROSS JOIN (SELECT DISTINCT metric FROM (" + _RUNS + "))"


@query("j23_released", f"WITH r AS (SELECT release, {_PASSED} AS passed FROM ({_RELEASES})) SELECT release, bool_and(passed IS NOT NULL) AS complete, bool_and(coalesce(passed, false)) AS passed FROM r GROUP BY release")
def j23r(t: Tables) -> DataFrame:
    rows = t.sql(_RELEASES).selectExpr("release", "metric", "double(current) current", "double(baseline) baseline")
    return metrics.released(metrics.gates(rows, ["release"]), ["release"])


@query("e15_k3_stratified_split", "WITH n AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), c AS (SELECT p_type, n, CAST(round(n * 0.7) AS BIGINT) AS a, CAST(round(n * 0.15) AS BIGINT) AS b FROM n) SELECT p_type, unnest(['train', 'val', 'test']) AS split, unnest([a, b, n - a - b]) AS n, true AS in_order FROM c")
def k3(t: Tables) -> DataFrame:
    """Sizes of the splits of each label, and whether each split takes up where the one before ended in the seeded order."""
    split = ml.stratified(t.part.select("p_partkey", "p_type"), "p_partkey", "p_type").withColumn("h", F.xxhash64("p_partkey", F.lit(42)))
    sizes = split.groupBy("p_type", "split").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    before = Window.partitionBy("p_type").orderBy(F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2))
    return sizes.withColumn("in_order", F.coalesce(F.lag("high").over(before) < F.col("low"), F.lit(True))).select("p_type", "split", "n", "in_order")


@query("n6_split_check", "SELECT s AS split, count(*) AS n, 0::BIGINT AS shared FROM (SELECT CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 < 9 THEN 'val' ELSE 'test' END AS s FROM part) GROUP BY s UNION ALL SELECT 'missing', count(*) FILTER (p_partkey % 50 = 1), count(*) FILTER (p_partkey % 25 = 0) FROM part")
def n6(t: Tables) -> DataFrame:
    """Splits of which one lacks rows and two share rows: what the check counts."""
    made = t.part.select("p_partkey", F.when(F.col("p_partkey") % 10 < 7, "train").when(F.col("p_partkey") % 10 < 9, "val").otherwise("test").alias("split"))
    broken = made.where("p_partkey % 50 <> 1").unionByName(made.where("p_partkey % 25 = 0").withColumn("split", F.lit("again")))
    ok, bad = checks.splits(made, t.part, "p_partkey"), checks.splits(broken, t.part, "p_partkey")
    return ok.where("split <> 'missing'").unionByName(bad.where("split = 'missing'"))


@query("k4_impute_scale", "WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS q, l_linenumber <= 3 AS train FROM lineitem), m AS (SELECT median(q) AS med FROM r WHERE train), f AS (SELECT l_orderkey, l_linenumber, train, coalesce(q, med) AS q FROM r, m), s AS (SELECT avg(q) AS mu, stddev_pop(q) AS sd FROM f WHERE train) SELECT l_orderkey, l_linenumber, round((q - mu) / sd, 6) AS q FROM f, s")
def k4(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 10 != 0, F.col("l_quantity")).alias("q"))
    return ml.imputed_and_scaled(rows, ["q"], F.col("l_linenumber") <= 3).withColumn("q", F.round("q", 6))


def _features(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_quantity") * F.col("l_discount") > 1).cast("int").alias("y"))


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("k5_k6_k7_classifiers")
def k5(t: Tables) -> DataFrame:
    """Soft vote of a forest of classes that weigh alike and boosted trees with weighed positives, on the test split."""
    split = ml.stratified(_features(t), "id", "y")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    models = [ml.fitted(train, _COLUMNS, "y", "forest", numTrees=20, maxDepth=5), ml.fitted(train, _COLUMNS, "y", "boosted", maxIter=10, maxDepth=3)]
    p = ml.averaged(*[ml.probabilities(m, test, _COLUMNS, "y", "id") for m in models])
    return p.join(test.select("id", "y"), "id").agg(*[c.alias(k) for k, c in metrics.confusion(F.col("y"), F.col("p") >= 0.5).items()])


def _small(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.length("p_name").cast("double").alias("chars"), F.expr("int((p_size - 25) * (length(p_name) - 9.5) > 6)").alias("y"))


_SMALL = ["size", "price", "chars"]


@query("k5_forest_grid")
def k5g(t: Tables) -> DataFrame:
    """Three by three forests over five folds; the numbers of trees are smaller than :data:`ml.FOREST_GRID`'s, whose form this has."""
    return ml.searched(_small(t), _SMALL, "y", "id", "forest", {"numTrees": [3, 5, 9], "maxDepth": [2, 4, 6]})[1]


@query("k6_boosted_grid")
def k6g(t: Tables) -> DataFrame:
    """Two by three by two boosted models over five folds; rounds are fewer than :data:`ml.BOOSTED_GRID`'s."""
    return ml.searched(_small(t), _SMALL, "y", "id", "boosted", {"maxIter": [2, 4], "maxDepth": [1, 2, 3], "stepSize": [0.1, 0.3]})[1]


@query("k9_permuted_labels", "SELECT count(*) AS n, sum(y)::BIGINT AS positive, sum(y)::BIGINT AS were FROM (SELECT (l_quantity * l_discount > 1)::INT AS y FROM lineitem)")
def k9(t: Tables) -> DataFrame:
    """Labels dealt out anew: their sum stays."""
    rows = _features(t)
    dealt = ml.permuted(rows, "id", "y", 1).agg(F.count("*").alias("n"), F.sum("y").alias("positive"))
    return dealt.join(F.broadcast(rows.agg(F.sum("y").alias("were"))))


@query("k9_label_shuffles")
def k9r(t: Tables) -> DataFrame:
    split = ml.stratified(_small(t), "id", "y")
    return ml.label_shuffles(split.where("split = 'train'"), split.where("split = 'val'"), _SMALL, "y", "id", numTrees=5, maxDepth=4)


@query("k11_regressors")
def k11(t: Tables) -> DataFrame:
    """Mean of the best forest and the best boosted model of their grids, on held-out rows."""
    rows = _small(t).withColumn("target", F.col("size") * 3 + F.col("price") / 100)
    train, test = rows.where("pmod(xxhash64(id, 7), 5) <> 0"), rows.where("pmod(xxhash64(id, 7), 5) = 0")
    grids = {"forest_regression": {"numTrees": [3, 5], "maxDepth": [2, 4]}, "boosted_regression": {"maxIter": [3], "maxDepth": [2, 3]}}
    found = [ml.searched(train, _SMALL, "target", "id", kind, grid)[0].transform(ml.assembled(test, _SMALL, "target")).select("id", F.col("prediction").alias("p")) for kind, grid in grids.items()]
    return ml.averaged(*found).join(test.select("id", "target"), "id").agg(*[c.alias(k) for k, c in metrics.regression(F.col("target"), F.col("p")).items()])


_BAD = "CASE WHEN {p} % 11 = 0 THEN 'empty' WHEN {p} % 13 = 0 THEN 'salt' END"


@query("k12_inference", f"WITH s AS (SELECT p_partkey AS id, {_BAD.format(p='p_partkey')} AS bad, p_partkey % 17 = 0 AS lacks FROM part), o AS (SELECT id, CASE WHEN bad IS NOT NULL THEN 'standardization_failed:' || bad WHEN lacks THEN 'featurization_failed' ELSE 'ok' END AS status FROM s) SELECT id, status, status = 'ok' AS scored FROM o")
def k12(t: Tables) -> DataFrame:
    rows = _small(t).withColumn("size", F.when(F.col("id") % 17 != 0, F.col("size")))
    model = ml.fitted(_small(t), _SMALL, "y", "forest", numTrees=3, maxDepth=3)
    out = ml.inferred(rows.drop("y"), model, _SMALL, "id", F.expr(_BAD.format(p="id")))
    return out.select("id", "status", (F.col("p").isNotNull() & F.col("sweet").isNotNull()).alias("scored"))


# a tree of three splits over two features: size at most 25, then price at most 910 on the left and size at most 40 on the right
_LEAVES = "CASE WHEN p_size <= 25 THEN CASE WHEN p_retailprice <= 910 THEN 3 ELSE 4 END WHEN p_size <= 40 THEN 5 ELSE 6 END"
_TREE = [(0, 0, 25.0, 1, 2, (3, 4, 5, 6)), (1, 1, 910.0, 3, 4, (3, 4)), (2, 0, 40.0, 5, 6, (5, 6)), *[(k, None, None, None, None, (k,)) for k in (3, 4, 5, 6)]]


@query("k10_tree_parts", f"""WITH r AS (SELECT p_partkey AS id, p_size AS s, p_retailprice AS p, {_LEAVES} AS leaf, length(p_name)::DOUBLE AS y FROM part), l AS (SELECT leaf, avg(y) AS v, count(*)::DOUBLE AS n FROM r GROUP BY leaf),
g AS (SELECT max(v) FILTER (leaf = 3) AS v3, max(v) FILTER (leaf = 4) AS v4, max(v) FILTER (leaf = 5) AS v5, max(v) FILTER (leaf = 6) AS v6, max(n) FILTER (leaf = 3) AS n3, max(n) FILTER (leaf = 4) AS n4, max(n) FILTER (leaf = 5) AS n5, max(n) FILTER (leaf = 6) AS n6 FROM l),
h AS (SELECT id, CASE WHEN s <= 25 THEN CASE WHEN p <= 910 THEN v3 ELSE v4 END WHEN s <= 40 THEN v5 ELSE v6 END AS both_known,
  CASE WHEN s <= 25 THEN (n3 * v3 + n4 * v4) / (n3 + n4) WHEN s <= 40 THEN v5 ELSE v6 END AS size_known,
  ((n3 + n4) * CASE WHEN p <= 910 THEN v3 ELSE v4 END + n5 * v5 + n6 * v6) / (n3 + n4 + n5 + n6) AS price_known,
  (n3 * v3 + n4 * v4 + n5 * v5 + n6 * v6) / (n3 + n4 + n5 + n6) AS none_known FROM r, g)
SELECT id, round(none_known, 6) AS base, round(both_known, 6) AS output, round((size_known - none_known + both_known - price_known) / 2, 6) AS size_part, round((price_known - none_known + both_known - size_known) / 2, 6) AS price_part FROM h""")
def k10(t: Tables) -> DataFrame:
    """A tree whose splits are stated and whose leaves are means over the table: the parts of its two features are those over all subsets."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.expr(_LEAVES).alias("leaf"), F.length("p_name").cast("double").alias("y"))
    shape = ", ".join(f"({k}, {'NULL' if f is None else f}, {'NULL' if c is None else c}, {a or 'NULL'}, {b or 'NULL'}, array{leaves if len(leaves) > 1 else f'({leaves[0]})'})" for k, f, c, a, b, leaves in _TREE)
    tree = t.spark.sql(f"SELECT node, int(feature) AS feature, double(threshold) AS threshold, int(a) AS left, int(b) AS right, leaves FROM VALUES {shape} AS v(node, feature, threshold, a, b, leaves)")
    found = rows.groupBy("leaf").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    sums = tree.select("node", F.explode("leaves").alias("leaf")).join(F.broadcast(found), "leaf").groupBy("node").agg((F.sum("y") / F.sum("n")).alias("value"), F.sum("n").cast("double").alias("cover"))
    nodes = tree.join(sums, "node", "left").fillna(0.0, ["value", "cover"]).select(F.lit(0).alias("tree"), "node", "feature", "threshold", F.lit(None).cast("array<double>").alias("categories"), "left", "right", "value", "cover", F.lit(1.0).alias("weight"))
    out = attributions.attributed(rows, nodes, ["size", "price"], "id")
    return out.select("id", F.round("base", 6).alias("base"), F.round("output", 6).alias("output"), *[F.round(F.get("parts", i), 6).alias(n) for i, n in enumerate(("size_part", "price_part"))])


@query("k10_strongest_features")
def k10s(t: Tables) -> DataFrame:
    """Columns by their mean part in a fitted forest's output on held-out rows."""
    split = ml.stratified(_features(t), "id", "y")
    model = ml.fitted(split.where("split = 'train'"), _COLUMNS, "y", "forest", numTrees=20, maxDepth=5)
    return attributions.strongest(attributions.attributed(split.where("split = 'val'"), attributions.node_table(model), _COLUMNS, "id"), _COLUMNS)


@query("k10_explained_predictions")
def k10e(t: Tables) -> DataFrame:
    """Every held-out row's margin under boosted trees, with what each column adds to it."""
    split = ml.stratified(_features(t), "id", "y")
    model = ml.fitted(split.where("split = 'train'"), _COLUMNS, "y", "boosted", maxIter=10, maxDepth=3)
    out = attributions.attributed(split.where("split = 'test'"), attributions.node_table(model), _COLUMNS, "id")
    return out.select("id", F.round("base", 9).alias("base"), F.round("output", 9).alias("margin"), *[F.round(F.get("parts", i), 9).alias(c) for i, c in enumerate(_COLUMNS)])
