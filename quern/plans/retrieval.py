"""Queries of retrieval, question understanding, ranking and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text, vectors
from quern.functions.numbers import threshold_grid
from quern.operators import queries as q
from quern.operators import ranking, retrieval
from quern.plans.base import Tables, query
from quern.plans.proxies import PAPERS

#: The query set of the searches: every vector whose id is divisible by 20, against all vectors.
_ASKED = "vec_id % 20 = 0"
_SCORED = f"""SELECT a.vec_id AS query_id, b.vec_id, b.label, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a, embeddings b WHERE a.{_ASKED}"""
_HITS = f"s AS ({_SCORED}), hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {{k}})"


def asked(t: Tables) -> DataFrame:
    """Query vectors: a stated set that grows with the table."""
    return t.embeddings.where(_ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def hits(t: Tables, k: int) -> DataFrame:
    return retrieval.search(t.embeddings, asked(t), k, ["label"])


@query("flagship", f"WITH s AS ({_SCORED}), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rn FROM s WHERE score >= 0.1) SELECT query_id, label AS paper, count(*) AS n_chunks, round(max(score), 6) AS max_score FROM c WHERE rn <= 2 GROUP BY ALL")
def flagship(t: Tables) -> DataFrame:
    kept = retrieval.search_each(t.embeddings, asked(t), ["label"], 2, 0.1)
    return retrieval.by_paper(kept, ["query_id", "label"], "vec_id").select("query_id", F.col("label").alias("paper"), "n_chunks", F.round("max_score", 6).alias("max_score"))


@query("i1_unit_vectors", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / coalesce(nullif(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0), 1), 6) AS head FROM embeddings")
def i1(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(vectors.unit(F.col("embedding")), 0), 6).alias("head"))


@query("i2_f1_vector_top_k", f"WITH {_HITS.format(k=10)} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM hits")
def i2(t: Tables) -> DataFrame:
    return hits(t, 10).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("b18_threshold_after_limit", f"WITH {_HITS.format(k=10)} SELECT query_id, vec_id, round(score, 6) AS score FROM hits WHERE score >= 0.2")
def b18(t: Tables) -> DataFrame:
    return hits(t, 10).where(retrieval.passes(0.2)).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("c1_hits_join_rows", f"WITH {_HITS.format(k=5)} SELECT query_id, rank, doc_id, sha256(text) AS digest, source FROM hits JOIN documents ON doc_id = vec_id")
def c1(t: Tables) -> DataFrame:
    found = hits(t, 5).select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("vec_id").alias("doc_id"))
    return found.join(t.documents, "doc_id").select("query_id", "rank", "doc_id", F.sha2("text", 256).alias("digest"), "source")


@query("c2_c3_lookups", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7 ORDER BY turn")
def c2(t: Tables) -> DataFrame:
    return t.conversations.where("conv_id = 7").select("conv_id", "turn", "role").orderBy("turn")


@query("i4_e4_f2_multi_query", f"WITH {_HITS.format(k=40)}, b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, query_id, rank) AS rn FROM hits) SELECT vec_id, label, query_id, round(score, 6) AS score FROM b WHERE rn = 1 ORDER BY b.score DESC, vec_id LIMIT 100")
def i4(t: Tables) -> DataFrame:
    return retrieval.merged(hits(t, 40), ["vec_id", "label"], 100).select("vec_id", "label", "query_id", F.round("score", 6).alias("score"))


@query("e1_cap_per_paper", f"WITH {_HITS.format(k=60)}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rn FROM hits) SELECT query_id, label, vec_id, rn FROM c WHERE rn <= 2")
def e1(t: Tables) -> DataFrame:
    return retrieval.capped(hits(t, 60), ["query_id", "label"], 2, "vec_id").select("query_id", "label", "vec_id", F.col("rn").cast("bigint").alias("rn"))


@query("e2_j9_diversify", f"""WITH {_HITS.format(k=200)}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rn FROM hits),
k AS (SELECT * FROM c WHERE rn <= 3), r AS (SELECT *, count(*) OVER w AS taken, sum((rn = 1)::INT) OVER w AS papers FROM k WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, coalesce(max((papers >= 2 AND taken >= 18)::INT) OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM r)
SELECT query_id, vec_id, label, taken FROM d WHERE done = 0""")
def e2(t: Tables) -> DataFrame:
    return retrieval.diversified(hits(t, 200), "query_id", "label", "vec_id", 3, 2).select("query_id", "vec_id", "label", "taken")


@query("d1_j10_by_paper", f"WITH {_HITS.format(k=50)} SELECT query_id, label, round(max(score), 6) AS max_score, count(*) AS n_chunks, string_agg(vec_id::VARCHAR, ',' ORDER BY score DESC, vec_id) AS chunk_ids FROM hits GROUP BY ALL")
def d1(t: Tables) -> DataFrame:
    return retrieval.by_paper(hits(t, 50), ["query_id", "label"], "vec_id").withColumn("max_score", F.round("max_score", 6))


q_grid = threshold_grid(0.4, 0.05, 0.1)
_GRID = "CASE " + " ".join(f"WHEN kth >= {g!r} THEN {g!r}" for g in q_grid) + " END"


@query("j8_relaxed_threshold", f"""WITH {_HITS.format(k=120)}, p AS (SELECT query_id, label, max(score) AS v FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, label) AS rn FROM p),
k AS (SELECT query_id, max(v) FILTER (rn = 6) AS kth FROM r GROUP BY query_id) SELECT query_id, round(coalesce({_GRID}, {q_grid[-1]!r})::DOUBLE, 9) AS effective_threshold, ({_GRID}) IS NULL AS fallback_used FROM k""")
def j8(t: Tables) -> DataFrame:
    out = retrieval.relaxed_threshold(hits(t, 120), "query_id", "label", 0.4, 0.05, 0.1, 6)
    return out.withColumn("effective_threshold", F.round("effective_threshold", 9))


@query("j8_relaxed_chunks", f"""WITH {_HITS.format(k=120)}, p AS (SELECT query_id, label, max(score) AS v FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, label) AS rn FROM p),
k AS (SELECT query_id, max(v) FILTER (rn = 6) AS kth FROM r GROUP BY query_id), e AS (SELECT query_id, {_GRID} AS th FROM k) SELECT query_id, vec_id FROM hits JOIN e USING (query_id) WHERE th IS NULL OR score >= th""")
def j8c(t: Tables) -> DataFrame:
    return retrieval.relaxed(hits(t, 120), "query_id", "label", 0.4, 0.05, 0.1, 6).select("query_id", "vec_id")


@query("i5_dimensions", "SELECT len(embedding)::INT AS dimension, count(*) AS n FROM embeddings GROUP BY ALL")
def i5(t: Tables) -> DataFrame:
    return t.embeddings.groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))


_word = lambda low: "(" + " | ".join(f"(CASE WHEN embedding[{low + i + 1}] > 0 THEN {1 << i} ELSE 0 END)" for i in range(32)) + ")::BIGINT"
_UNION, _COMMON = ("(bit_count(a.v {0} b.v) + bit_count(a.w {0} b.w))".format(sign) for sign in "|&")


@query("i8_tanimoto", f"WITH b AS (SELECT vec_id, {_word(0)} AS v, {_word(32)} AS w FROM embeddings) SELECT a.vec_id AS query_id, b.vec_id, round(CASE WHEN {_UNION} = 0 THEN 0.0 ELSE 1 - {_COMMON} / {_UNION}::DOUBLE END, 6) AS distance FROM b a, b WHERE a.{_ASKED}")
def i8(t: Tables) -> DataFrame:
    sets = t.embeddings.select("vec_id", vectors.sign_words(F.col("embedding")).alias("words"))
    some = sets.where(_ASKED).select(F.col("vec_id").alias("query_id"), F.col("words").alias("asked"))
    pairs = retrieval.met(sets, some)
    return pairs.select("query_id", "vec_id", F.round(vectors.tanimoto_distance(F.col("asked"), F.col("words")), 6).alias("distance"))


QUESTIONS = """
SELECT c_custkey AS id, CASE CAST(c_custkey % 9 AS INT) WHEN 0 THEN 'How does stevia bind the sweet receptor T1R2 and why?' WHEN 1 THEN '如何比较阿斯巴甜和三氯蔗糖的甜度与后味'
  WHEN 2 THEN 'glucose' WHEN 3 THEN 'review of the mechanism, evidence and limitation of erythritol in beverage and dairy baking' WHEN 4 THEN '' WHEN 5 THEN '糖尿病 相关 机制 与肠道菌群之间的关系是什么'
  WHEN 6 THEN 'monk fruit OR sugar' WHEN 7 THEN 'compare BMI difference pathway' ELSE lower(c_mktsegment) || ' and ' || c_name END AS question FROM {customer}
"""


def _concepts_sql(c: str) -> str:
    return "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(lower({c}), '{t}') THEN '{s}' END" for t, s in q.INDEX.items()) + "], lambda x: x IS NOT NULL)))"


_TOKENS = f"list_sort(list_distinct(list_concat(regexp_extract_all(t, '[a-z][a-z0-9+._-]{{2,}}'), list_filter(flatten(list_transform(regexp_extract_all(t, '[一-鿿]{{2,}}'), lambda r: regexp_split_to_array(r, '{q.PARTICLES}'))), lambda p: length(p) >= 2 AND p NOT IN ({', '.join(repr(s) for s in q.STOPWORDS)})))))"


@query("j5_topic_tokens", f"WITH a AS (SELECT id, regexp_replace(lower(trim(question, ' ')), '({q.QUESTION_WORDS})', ' ', 'g') AS t FROM ({QUESTIONS})) SELECT id, array_to_string({_TOKENS}, '|') AS tokens FROM a")
def j5(t: Tables) -> DataFrame:
    return t.sql(QUESTIONS).select("id", F.array_join(q.topic_tokens(F.col("question")), "|").alias("tokens"))


@query("j6_h43_concepts", f"WITH a AS ({QUESTIONS}) SELECT id, coalesce(array_to_string({_concepts_sql('question')}, '|'), '') AS concepts FROM a")
def j6(t: Tables) -> DataFrame:
    return t.sql(QUESTIONS).select("id", F.array_join(q.concepts_of(F.col("question")), "|").alias("concepts"))


_ALL: dict[str, list[str]] = {}
for _d in (q.SWEETENERS, q.CONCEPTS):
    for _k, _v in _d.items():
        _ALL.setdefault(_k, []).extend(_v)
_EXPAND = "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN list_contains(cs, '{k}') THEN [{', '.join(repr(x) for x in v)}] ELSE []::VARCHAR[] END" for k, v in _ALL.items()) + "])))"


@query("j2_j3_expansion", f"WITH a AS (SELECT id, question, {_concepts_sql('question')} AS cs FROM ({QUESTIONS})) SELECT id, array_to_string(list_concat([question], {_EXPAND})[1:10], ' OR ') AS search FROM a")
def j2(t: Tables) -> DataFrame:
    return t.sql(QUESTIONS).select("id", q.expansion(F.col("question")).alias("search"))


@query("j4_variants", f"""WITH a AS (SELECT id, question, {_concepts_sql('question')} AS cs, regexp_replace(lower(trim(question, ' ')), '({q.QUESTION_WORDS})', ' ', 'g') AS t FROM ({QUESTIONS})),
b AS (SELECT id, question, array_to_string(list_concat([question], {_EXPAND})[1:10], ' OR ') AS e, {_TOKENS} AS k FROM a),
c AS (SELECT id, list_filter(list_transform([e, question, CASE WHEN contains(e, ' OR ') THEN split_part(e, ' OR ', 1) END, CASE WHEN len(k) > 0 THEN array_to_string(k[1:3], ' ') END, CASE WHEN len(k) >= 2 THEN k[1] || ' ' || k[2] || ' 相互作用 机制' END], lambda x: nullif(trim(x, ' '), '')), lambda x: x IS NOT NULL) AS l FROM b)
SELECT id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], ' | '), '') AS variants FROM c""")
def j4(t: Tables) -> DataFrame:
    c = F.col("question")
    parts = max(t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    questions = t.sql(QUESTIONS).repartition(parts)  # short rows with much work each: a file of many is a single task's
    expanded = questions.select("id", "question", q.expansion(c).alias("expanded"))
    return expanded.select("id", F.array_join(q.variants(F.col("expanded"), c), " | ").alias("variants"))


_CUES = " + ".join(f"CASE WHEN contains(lower(question), '{x}') THEN {w} ELSE 0 END" for x, w in [*((x, 0.15) for x in q.COMPLEX_CUES), *((x, 0.08) for x in q.BROAD_CUES)])


@query("h35_h36_complexity", f"WITH a AS (SELECT id, CASE WHEN question = '' THEN 0.0 ELSE least(1.0, least(0.4, length(question) / 120.0) + {_CUES}) END::DOUBLE AS s FROM ({QUESTIONS})) SELECT id, round(s, 6) AS complexity, (CASE WHEN s < 0.2 THEN 13 WHEN s < 0.3 THEN 23 WHEN s < 0.55 THEN 30 ELSE 30 END)::INT AS most FROM a")
def h35(t: Tables) -> DataFrame:
    s = F.round(q.complexity(F.col("question")), 9)
    return t.sql(QUESTIONS).select("id", F.round(s, 6).alias("complexity"), q.reference_window(s, 8, 30).alias("most"))


_TERMS = ["ring", "bolt", "red"]
_CONCEPT = {"size": ["small", "large"], "colour": ["blue", "green"]}


def _has(c: str, words) -> str:
    return " + ".join(f"contains(lower({c}), '{w}')::INT" for w in words)


@query("j7_overlap", f"SELECT p_partkey, ({_has('p_name', _TERMS)})::INT AS overlap, (({_has('p_name', _CONCEPT['size'])}) > 0)::INT + (({_has('p_name', _CONCEPT['colour'])}) > 0)::INT AS concept_hits FROM part")
def j7(t: Tables) -> DataFrame:
    o, c = ranking.overlap_of(F.col("p_name"), _TERMS, _CONCEPT)
    return t.part.select("p_partkey", o.alias("overlap"), c.alias("concept_hits"))


@query("b17_signal_override", f"WITH o AS (SELECT p_partkey, p_retailprice / 2000 AS score, {_has('p_name', _TERMS)} AS o, (({_has('p_name', _CONCEPT['size'])}) > 0)::INT + (({_has('p_name', _CONCEPT['colour'])}) > 0)::INT AS c FROM part) SELECT p_partkey FROM o WHERE score >= 0.5 OR o >= 2 OR c > 0")
def b17(t: Tables) -> DataFrame:
    o, c = ranking.overlap_of(F.col("p_name"), _TERMS, _CONCEPT)
    return t.part.withColumn("score", F.col("p_retailprice") / 2000).where(retrieval.passes(0.5, o, c)).select("p_partkey")


REFS = f"""
SELECT p.id, p.file_path, p.title, p.journal, p.year, CAST(p.id % 97 AS DOUBLE) / 97 AS score,
  CASE CAST(p.id % 6 AS INT) WHEN 0 THEN 'We found that it was measured significantly in a cohort.' WHEN 1 THEN 'A systematic review of the literature reported that' WHEN 2 THEN 'observed in vitro'
    WHEN 3 THEN '' WHEN 4 THEN 'meta-analysis and case-control' ELSE p.filename END AS content
FROM ({PAPERS}) p
"""
_T = "lower(coalesce(title, '') || ' ' || left(content, 800))"
_STUDY = "greatest(2.0, " + ", ".join(f"CASE WHEN contains({_T}, '{k}') THEN {v} ELSE 0 END" for k, v in ranking.STUDY_TYPES.items()) + ")"
_C = "lower(left(content, 1500))"
_EXP, _REV = ("(" + " + ".join(f"contains({_C}, '{w}')::INT" for w in words) + ")" for words in (ranking.EXPERIMENT_CUES, ranking.REVIEW_CUES))
_J = lambda words: "(" + " OR ".join(f"contains(lower(coalesce(journal, '')), '{w}')" for w in words) + ")"
_RANKED = f"""r AS ({REFS}), s AS (SELECT *, least(5.0, score * 10)::DOUBLE AS a, {_STUDY}::DOUBLE AS b,
  CASE WHEN {_EXP} >= 2 THEN 4.5 WHEN {_REV} >= 2 THEN 2.5 WHEN {_EXP} = 1 THEN 3.5 ELSE 2.0 END::DOUBLE AS c, CASE WHEN {_EXP} >= 2 THEN 'experimental' WHEN {_REV} >= 2 THEN 'review_citation' WHEN {_EXP} = 1 THEN 'experimental' ELSE 'indirect' END AS evidence_type,
  CASE WHEN {_J(ranking.TOP_JOURNALS)} THEN 5.0 WHEN {_J(ranking.SECOND_JOURNALS)} THEN 3.5 ELSE 2.0 END::DOUBLE AS d, TRY_CAST(regexp_extract(year, '(19|20)\\d{{2}}') AS INT) AS y FROM r),
v AS (SELECT *, CASE WHEN y IS NULL THEN 3.0 WHEN 2026 - y <= 2 THEN 5.0 WHEN 2026 - y <= 5 THEN 4.0 WHEN 2026 - y <= 10 THEN 3.0 WHEN 2026 - y <= 20 THEN 2.0 ELSE 1.0 END::DOUBLE AS e FROM s),
w AS (SELECT *, round(a * 0.35 + b * 0.2 + c * 0.2 + d * 0.1 + e * 0.1, 6) AS total FROM v), f AS (SELECT *, round(score * 0.6 + round(total, 2) / 5.0 * 0.4, 6) AS final FROM w)"""


@query("j12_j13_evidence", f"WITH {_RANKED} SELECT id, evidence_type, CASE WHEN total >= 3.2 THEN 'strong' WHEN total >= 2.2 THEN 'moderate' ELSE 'weak' END AS evidence_level, total AS total_score, round(final, 2) AS final_score FROM f")
def j12(t: Tables) -> DataFrame:
    return ranking.evidence_ranked(t.sql(REFS), 2026).select("id", "evidence_type", "evidence_level", "total_score", F.round("final_score", 2).alias("final_score"))


@query("e3_j14_reference_ids", f"WITH o AS (SELECT p_partkey, p_brand, {_has('p_name', _TERMS)} AS o, (({_has('p_name', _CONCEPT['size'])}) > 0)::INT + (({_has('p_name', _CONCEPT['colour'])}) > 0)::INT AS c, p_retailprice / 2000 AS base FROM part) SELECT p_brand, p_partkey, 'ref_' || row_number() OVER (PARTITION BY p_brand ORDER BY c * 1000 + o * 10 + base DESC, p_partkey) AS ref_id FROM o")
def e3(t: Tables) -> DataFrame:
    o, c = ranking.overlap_of(F.col("p_name"), _TERMS, _CONCEPT)
    scored = t.part.withColumn("s", ranking.topic_score(F.col("p_retailprice") / 2000, o, c))
    return ranking.numbered(scored, [F.desc("s"), F.asc("p_partkey")], ["p_brand"]).select("p_brand", "p_partkey", "ref_id")


_CATALOG = "SELECT CAST(p_partkey AS STRING) AS file_path, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name || CAST(p_partkey % 50 AS STRING) END AS title, CASE WHEN p_partkey % 9 = 0 THEN 'N/A' ELSE CAST(1980 + p_partkey % 44 AS STRING) END AS year FROM {part}"


@query("c10_f3_j15_supplement", f"""WITH c AS ({_CATALOG}), r AS (SELECT file_path, title FROM c WHERE file_path IN ('3', '17', '26')), o AS (SELECT *, {_has("coalesce(title, '')", _TERMS)} AS o, (({_has("coalesce(title, '')", _CONCEPT['size'])}) > 0)::INT + (({_has("coalesce(title, '')", _CONCEPT['colour'])}) > 0)::INT AS h, coalesce(TRY_CAST(regexp_extract(year, '(19|20)\\d{{2}}') AS INT), 0) AS y FROM c
  WHERE file_path NOT IN (SELECT file_path FROM r) AND lower(coalesce(title, '')) NOT IN (SELECT lower(coalesce(title, '')) FROM r)),
s AS (SELECT * FROM o ORDER BY (o > 0 OR h > 0) DESC, CASE WHEN o > 0 OR h > 0 THEN h END DESC NULLS LAST, CASE WHEN o > 0 OR h > 0 THEN o END DESC NULLS LAST, y DESC, file_path LIMIT 37)
SELECT file_path, title, 0.5::DOUBLE AS score, false AS supplemented FROM r UNION ALL SELECT file_path, title, round(0.04 + 0.01 * o, 6)::DOUBLE, true FROM s""")
def j15(t: Tables) -> DataFrame:
    catalog = t.sql(_CATALOG)
    refs = catalog.where("file_path in ('3', '17', '26')").select("file_path", "title", F.lit(0.5).alias("score"))
    o, h = ranking.overlap_of(F.coalesce(F.col("title"), F.lit("")), _TERMS, _CONCEPT)
    return ranking.supplemented(refs, catalog, 40, o, h).withColumn("score", F.round("score", 6))


@query("j16_context_packing")
def j16(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", F.expr("int(turn div 2)").alias("ref_no"), F.expr("int(turn % 2)").alias("chunk_no"), F.length(text.citation_noise_removed(F.col("text"))).alias("n"))
    return ranking.packed(rows, "conv_id", 400)


@query("j17_prompt", "WITH t AS (SELECT p_brand, 'ref_' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) || ': ' || p_name AS line, p_partkey, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, string_agg(line, chr(10) ORDER BY p_partkey) AS refs, least(greatest(4, any_value(n) // 4), 10)::INT AS citations, least(greatest(6, any_value(n) // 3), 14)::INT AS citations_dual FROM t GROUP BY p_brand")
def j17(t: Tables) -> DataFrame:
    rows = ranking.numbered(t.part, [F.asc("p_partkey")], ["p_brand"])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat("ref_id", F.lit(": "), "p_name").alias("l")))), lambda x: x["l"]), "\n")
    n = F.count("*")
    least = lambda d, a, b: F.least(F.greatest(F.lit(a), F.floor(n / d)), F.lit(b)).cast("int")
    return rows.groupBy("p_brand").agg(lines.alias("refs"), least(4, 4, 10).alias("citations"), least(3, 6, 14).alias("citations_dual"))


@query("j18_payload", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0.05 THEN 0.0 ELSE round(l_extendedprice / l_quantity, 7) END AS score, TRY_CAST(l_returnflag AS INT) AS page FROM lineitem")
def j18(t: Tables) -> DataFrame:
    raw = F.when(F.col("l_discount") == 0.05, F.lit(float("nan"))).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.isnan(raw), 0.0).otherwise(F.round(raw, 7)).alias("score"), F.col("l_returnflag").try_cast("int").alias("page"))


@query("j19_j20_statistics", f"WITH {_HITS.format(k=120)} SELECT query_id, count(*) AS raw_chunks, count(*) FILTER (score >= 0.2) AS after_threshold, count(DISTINCT label) FILTER (score >= 0.2) AS unique_papers, count(DISTINCT label) FILTER (score >= 0.2) < 6 AS few FROM hits GROUP BY query_id")
def j20(t: Tables) -> DataFrame:
    over = F.col("score") >= 0.2
    papers = F.count_distinct(F.when(over, F.col("label")))
    return hits(t, 120).groupBy("query_id").agg(F.count("*").alias("raw_chunks"), F.count_if(over).alias("after_threshold"), papers.alias("unique_papers"), (papers < 6).alias("few"))


@query("k13_embedding")
def k13(t: Tables) -> DataFrame:
    from quern.sources import boundaries

    rows = boundaries.embedded(t.part.select("p_partkey", "p_name"), "p_name", lambda: boundaries.hashing_encoder(16))
    return rows.select("p_partkey", F.size("embedding").alias("dimension"), F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


@query("b21_clamped_parameters", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 20 BETWEEN 0 AND 1 THEN l_discount * 20 ELSE 0.3 END AS threshold, CAST(least(greatest(l_quantity * 10, 1), 200) AS INT) AS max_results FROM lineitem")
def b21(t: Tables) -> DataFrame:
    d = F.col("l_discount") * 20
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(d.between(0, 1), d).otherwise(0.3).alias("threshold"), F.least(F.greatest(F.col("l_quantity") * 10, F.lit(1)), F.lit(200)).cast("int").alias("max_results"))


@query("i3_adapter_retrieve", f"WITH {_HITS.format(k=1)} SELECT query_id, vec_id FROM hits")
def i3(t: Tables) -> DataFrame:
    """Without a threshold, and at least one hit whatever k is asked for."""
    return hits(t, max(1, 0)).select("query_id", "vec_id")


@query("c16_term_counts", f"WITH q AS ({QUESTIONS}) SELECT id, ({_has('question', ['stevia', 'monk', 'sugar'])})::INT AS terms FROM q")
def c16(t: Tables) -> DataFrame:
    return t.sql(QUESTIONS).select("id", text.count_contained(F.col("question"), ["stevia", "monk", "sugar"]).alias("terms"))


_RELATED = "CASE lower(w) " + " ".join(f"WHEN '{t}' THEN '{'|'.join({**q.CONCEPTS, **q.SWEETENERS}[s])}'" for t, s in q.INDEX.items()) + " ELSE '' END"
_ASKED_TERMS = "SELECT n_nationkey AS id, CASE CAST(n_nationkey % 5 AS INT) WHEN 0 THEN 'Glucose' WHEN 1 THEN 'stevia' WHEN 2 THEN '甜味' WHEN 3 THEN 'nothing' ELSE 'apm' END AS w FROM {nation}"


@query("j3_related_terms", f"SELECT id, {_RELATED} AS terms FROM ({_ASKED_TERMS})")
def j3(t: Tables) -> DataFrame:
    return t.sql(_ASKED_TERMS).select("id", F.array_join(q.related_terms(F.col("w")), "|").alias("terms"))


_SEEN = f"SELECT id, coalesce(file_path, '') || CAST(id AS STRING) AS file_path, filename, CAST(id % 97 AS DOUBLE) / 97 AS score, title, journal, year, doi FROM ({PAPERS})"


@query("j11_references", f"""WITH p AS ({_SEEN}), c AS (SELECT * FROM p WHERE id % 3 = 0) SELECT p.id, CASE WHEN c.id IS NOT NULL THEN coalesce(c.title, 'Unknown Title') ELSE p.filename END AS title,
CASE WHEN c.id IS NOT NULL THEN coalesce(c.journal, 'Unknown Journal') WHEN contains(lower(p.file_path), 'datasets') OR contains(lower(p.filename), 'dataset') THEN 'dataset' ELSE 'Unknown' END AS journal,
CASE WHEN c.id IS NOT NULL THEN coalesce(c.year, 'N/A') ELSE 'N/A' END AS year, CASE WHEN c.id IS NOT NULL THEN coalesce(c.doi, 'Not Available') ELSE 'Not Available' END AS doi FROM p LEFT JOIN c ON p.file_path = c.file_path""")
def j11(t: Tables) -> DataFrame:
    seen = t.sql(_SEEN)
    out = ranking.references(seen.select("file_path", "filename", "score"), seen.where("id % 3 = 0"))
    return out.join(seen.select("id", "file_path"), "file_path").select("id", "title", "journal", "year", "doi")
