"""Queries of joins, aggregates, order, sets, duplicates, compounds and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import molecules, paths, text, vectors
from quern.operators import checks, compounds, containment, curation, ranges
from quern.operators import molecules as molecule_tables
from quern.plans.base import Tables, query
from quern.plans.proxies import COMPOUNDS, PAPERS


@query("b7_schema", "SELECT p_partkey::VARCHAR AS mol_id, p_name AS name, NULL::VARCHAR AS smiles_raw, NULL::VARCHAR AS smiles_canonical, NULL::VARCHAR AS inchi, NULL::VARCHAR AS inchi_key, p_brand AS source_db, NULL::VARCHAR AS source_id, NULL::VARCHAR AS source_refs, NULL::VARCHAR AS pubchem_cid, NULL::VARCHAR AS cas_number, p_type AS taste_class_raw, NULL::VARCHAR AS taste_class, NULL::TINYINT AS is_sweet, NULL::VARCHAR AS label_confidence, NULL::TINYINT AS is_natural, p_retailprice AS mw, p_size AS n_heavy_atoms FROM part")
def b7(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("mol_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("source_db"), F.col("p_type").alias("taste_class_raw"), F.col("p_retailprice").alias("mw"), F.col("p_size").alias("n_heavy_atoms"))
    return curation.conformed(rows, curation.MOLECULES)


@query("b9_b10_labels", "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Sweet' WHEN p_type IN ('SMALL', 'LARGE') THEN 'NonSweet' END AS label, (CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 1 ELSE 0 END)::INT AS is_sweet FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'SMALL', 'LARGE')")
def b9(t: Tables) -> DataFrame:
    label = text.mapped(F.col("p_type"), {"ECONOMY": "Sweet", "PROMO": "Sweet", "SMALL": "NonSweet", "LARGE": "NonSweet"})
    return t.part.select("p_partkey", label.alias("label")).where("label is not null").withColumn("is_sweet", (F.col("label") == "Sweet").cast("int"))


@query("c4_j11_lookup", f"""WITH p AS (SELECT id, file_path, filename FROM ({PAPERS})), a AS (SELECT p_name || '.pdf' AS key, p_type AS journal, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part),
b AS (SELECT DISTINCT regexp_extract(file_path, '[^/]*$') AS key FROM p WHERE file_path <> '') SELECT id, coalesce(a.journal, CASE WHEN b.key IS NOT NULL THEN 'by name' END) AS journal, (CASE WHEN a.key IS NOT NULL THEN 0 WHEN b.key IS NOT NULL THEN 1 END)::INT AS tier
FROM p LEFT JOIN a ON replace(regexp_extract(p.file_path, '[^/]*$'), '_', ' ') = a.key AND rn = 1 LEFT JOIN b ON p.filename = b.key""")
def c4(t: Tables) -> DataFrame:
    p = t.sql(PAPERS).select("id", "file_path", "filename", F.replace(paths.basename(F.col("file_path")), F.lit("_"), F.lit(" ")).alias("by_path"))
    a = curation.first_by_key(t.part.withColumn("key", F.concat("p_name", F.lit(".pdf"))), ["key"], [F.col("p_partkey")]).select("key", F.col("p_type").alias("journal"))
    b = p.where("file_path <> ''").select(paths.basename(F.col("file_path")).alias("key")).distinct().withColumn("journal", F.lit("by name"))
    return curation.looked_up(p, ["by_path", "filename"], [a, b], "journal").select("id", "journal", "tier")


@query("c5_enrich", "SELECT c_custkey, c_name, coalesce(nullif(CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END, ''), c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN nation ON lower(c_nationkey::VARCHAR) = lower(n_nationkey::VARCHAR)")
def c5(t: Tables) -> DataFrame:
    local = t.customer.select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("doi"), "c_mktsegment")
    remote = t.nation.select(F.col("n_nationkey").cast("string").alias("doi"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("c_mktsegment"))
    return curation.enriched(local, remote, "doi", ["c_mktsegment"]).drop("doi")


@query("c6_i11_title_match")
def c6(t: Tables) -> DataFrame:
    return compounds.best_titles(t.part.select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("title")), t.part.select(F.concat("p_name", F.lit(" "), "p_type", F.lit("s")).alias("title")), "p_partkey", "title")


@query("c7_g1_merge_sources", "SELECT c_nationkey AS key, c_custkey AS id, 'customer' AS src FROM customer WHERE c_nationkey < 20 UNION ALL SELECT s_nationkey, s_suppkey, 'supplier' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 20)")
def c7(t: Tables) -> DataFrame:
    a = t.customer.where("c_nationkey < 20").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("id"), F.lit("customer").alias("src"))
    b = t.supplier.select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("src"))
    return curation.merged_sources(a, b, "key").select("key", "id", "src")


@query("c8_term_semi_join", "SELECT DISTINCT p_partkey FROM part JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part WHERE p_size > 45) ON contains(p_name, w) WHERE w <> 'ring'")
def c8(t: Tables) -> DataFrame:
    words = t.part.where("p_size > 45").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w")).where("w <> 'ring'").distinct()
    return containment.containing(t.part.select("p_partkey", "p_name"), "p_name", words, "w", "left_semi").select("p_partkey")


@query("c9_new_files", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def c9(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("c11_orphans", "SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS mapped, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only FROM (SELECT DISTINCT vec_id AS a FROM embeddings) FULL JOIN (SELECT DISTINCT doc_id AS b FROM documents) ON a = b")
def c11(t: Tables) -> DataFrame:
    return curation.orphans(t.embeddings.select(F.col("vec_id").alias("k")), t.documents.select(F.col("doc_id").alias("k")), "k")


@query("c12_first_name", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber <> 1, l_linenumber)) AS part FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = count(*)")
def c12(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    return t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct((n != 1).alias("a"), n.alias("b"))).alias("part"), F.count_distinct("l_linenumber").alias("d"), F.count("*").alias("n")).where("d = n").select("l_orderkey", "part")


@query("c13_coordinates", "SELECT p_partkey, round(avg(l_quantity), 6) AS x, round(avg(l_discount), 6) AS y FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def c13(t: Tables) -> DataFrame:
    at = t.lineitem.groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("x"), F.round(F.avg("l_discount"), 6).alias("y"))
    return t.part.select("p_partkey").join(at, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "x", "y")


@query("c14_e13_citation_order", "WITH w AS (SELECT doc_id, unnest(list_distinct(['ref_' || (doc_id % 7), 'ref_' || (doc_id % 3), 'ref_' || (doc_id % 5)])) AS r FROM documents) SELECT doc_id, r, n_name FROM w JOIN nation ON r = 'ref_' || n_nationkey")
def c14(t: Tables) -> DataFrame:
    cited = F.concat(*[x for m in (7, 3, 5) for x in (F.lit("[ref_"), (F.col("doc_id") % m).cast("string"), F.lit("]"))])
    rows = t.documents.select("doc_id", F.posexplode(text.citation_ids(cited)).alias("pos", "r"))
    return rows.join(t.nation.select(F.concat(F.lit("ref_"), F.col("n_nationkey").cast("string")).alias("r"), "n_name"), "r").select("doc_id", "r", "n_name")


@query("d2_d4_counts", "SELECT count(*) AS n, count(nullif(toxic, 0)) AS present, count(DISTINCT quality) AS kinds FROM labels")
def d2(t: Tables) -> DataFrame:
    return t.labels.agg(F.count("*").alias("n"), F.count(F.nullif("toxic", F.lit(0))).alias("present"), F.count_distinct("quality").alias("kinds"))


@query("d3_value_counts", f"SELECT journal, count(*) AS n FROM ({PAPERS}) GROUP BY journal")
def d3(t: Tables) -> DataFrame:
    return t.sql(PAPERS).groupBy("journal").agg(F.count("*").alias("n"))


@query("d5_waterfall", "SELECT 'raw' AS stage, count(*) AS n FROM part UNION ALL SELECT 'named', count(*) FROM part WHERE p_name LIKE '%bolt%' UNION ALL SELECT 'priced', count(*) FROM part WHERE p_name LIKE '%bolt%' AND p_retailprice < 1000")
def d5(t: Tables) -> DataFrame:
    named = F.col("p_name").contains("bolt")
    one = t.part.agg(F.count("*").alias("raw"), F.count_if(named).alias("named"), F.count_if(named & (F.col("p_retailprice") < 1000)).alias("priced"))
    return one.unpivot([], ["raw", "named", "priced"], "stage", "n")


@query("d6_ratio", "SELECT p_brand, count(*) FILTER (p_size > 25) / nullif(count(*) FILTER (p_size = 1), 0) AS ratio FROM part GROUP BY p_brand")
def d6(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.try_divide(F.count_if(F.col("p_size") > 25), F.count_if(F.col("p_size") == 1)).alias("ratio"))


@query("d7_null_audit", f"WITH p AS ({PAPERS}) SELECT count(*) FILTER (title IS NULL OR title = '') AS title, count(*) FILTER (journal IS NULL OR journal = '') AS journal, count(*) FILTER (year IS NULL) AS year, count(*) FILTER (doi IS NULL) AS doi, count(filename) - count(DISTINCT filename) AS repeated FROM p")
def d7(t: Tables) -> DataFrame:
    empty = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(c)
    return t.sql(PAPERS).agg(*[empty(c) for c in ("title", "journal", "year", "doi")], (F.count("filename") - F.count_distinct("filename")).alias("repeated"))


@query("d19_profile", "SELECT 'quantity' AS descriptor, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS of_class FROM lineitem UNION ALL SELECT 'tax', round(avg(l_tax), 6), round(stddev_pop(l_tax), 6), min(l_tax), max(l_tax), round(avg(l_tax) FILTER (l_returnflag = 'R'), 6) FROM lineitem")
def d19(t: Tables) -> DataFrame:
    long_ = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax")).unpivot(["l_returnflag"], ["quantity", "tax"], "descriptor", "v")
    r6 = lambda c: F.round(c, 6)
    return long_.groupBy("descriptor").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"), r6(F.avg(F.when(F.col("l_returnflag") == "R", F.col("v")))).alias("of_class"))


@query("d18_pivot", "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY l_returnflag")
def d18(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_quantity"), 6))


@query("d20_d21_population", "SELECT l_returnflag, round(avg(l_discount), 9) AS mean, round(coalesce(nullif(stddev_pop(l_discount), 0), 1), 9) AS sd, round(avg(abs(l_quantity - 25)), 6) AS spread FROM lineitem GROUP BY l_returnflag")
def d20(t: Tables) -> DataFrame:
    sd = F.coalesce(F.nullif(F.stddev_pop("l_discount"), F.lit(0.0)), F.lit(1.0))
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 9).alias("mean"), F.round(sd, 9).alias("sd"), F.round(F.avg(F.abs(F.col("l_quantity") - 25)), 6).alias("spread"))


@query("d23_f4_largest", "SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents ORDER BY bytes DESC, doc_id LIMIT 10")
def d23(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes")).orderBy(F.desc("bytes"), "doc_id").limit(10)



@query("d24_d25_structure", "SELECT l_orderkey, count(*) AS atoms, count(DISTINCT (l_linestatus, l_partkey % 999)) AS residues, count(DISTINCT l_linestatus) AS chains, round(max(l_quantity) - min(l_quantity), 3) AS box_x, round(avg(l_quantity), 3) AS centre_x FROM lineitem GROUP BY l_orderkey")
def d24(t: Tables) -> DataFrame:
    c = F.col
    line = F.concat(F.rpad(F.lit("ATOM"), 6, " "), F.lpad(c("l_linenumber").cast("string"), 5, " "), F.lit("  CA  "), c("l_returnflag"), F.lit("LA "), c("l_linestatus"), F.lpad((c("l_partkey") % 999).cast("string"), 4, " "), F.lit("    "), F.lpad(F.format_string("%.3f", c("l_quantity")), 8, " "))
    return checks.structures(t.lineitem.select("l_orderkey", line.alias("line")), "l_orderkey")


@query("d26_d27_keeper", "SELECT sha256(text) AS digest, arg_max(doc_id, (n_chars, -doc_id)) AS kept, count(*) AS n, CASE WHEN count(DISTINCT source) = 1 THEN 'source' ELSE 'text' END AS reason FROM documents GROUP BY ALL")
def d26(t: Tables) -> DataFrame:
    best = F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id")))
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(best.alias("kept"), F.count("*").alias("n"), F.when(F.count_distinct("source") == 1, "source").otherwise("text").alias("reason"))


@query("d26_kept_copies")
def d26k(t: Tables) -> DataFrame:
    rows = t.sql(PAPERS).select("id", "filename", "title", F.pmod("id", F.lit(40)).alias("g"), F.pmod("id", F.lit(3)).alias("pages"), F.length("title").alias("size"))
    return curation.kept_copies(rows, "g", "filename", "title", "pages", "size")


@query("d28_d29_health", "SELECT count(*) FILTER (p_retailprice > 0) AS priced, count(*) FILTER (p_size > 10) AS sized, CASE WHEN bool_and(p_retailprice > 0) AND count(*) > 0 THEN 'ready' ELSE 'degraded' END AS state FROM part")
def d28(t: Tables) -> DataFrame:
    return t.part.agg(F.count_if(F.col("p_retailprice") > 0).alias("priced"), F.count_if(F.col("p_size") > 10).alias("sized"), F.when(F.bool_and(F.col("p_retailprice") > 0) & (F.count("*") > 0), "ready").otherwise("degraded").alias("state"))


@query("e5_keep_first", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def e5(t: Tables) -> DataFrame:
    return curation.first_by_key(t.part.select("p_name", "p_partkey"), ["p_name"], [F.col("p_partkey")])


@query("e14_ordinals", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders")
def e14(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("ordinal"))


@query("f5_nulls_last", f"SELECT cid, row_number() OVER (PARTITION BY kind ORDER BY sweetness DESC NULLS LAST, cid) AS down, row_number() OVER (PARTITION BY kind ORDER BY sweetness ASC NULLS LAST, cid) AS up FROM ({COMPOUNDS})")
def f5(t: Tables) -> DataFrame:
    rows = t.sql(COMPOUNDS).select("cid", "kind", "sweetness")
    for name, down in (("down", True), ("up", False)):
        rows = ranges.ranked(rows, ["kind"], [compounds.ordered(F.col("sweetness"), down), F.col("cid").asc()], name).drop(f"all_{name}")
    return rows.select("cid", "down", "up")


@query("f6_year_text_order", f"SELECT id, row_number() OVER (PARTITION BY journal ORDER BY year DESC NULLS LAST, id) AS place FROM ({PAPERS})")
def f6(t: Tables) -> DataFrame:
    rows = t.sql(PAPERS).select("id", "journal", "year")
    return ranges.ranked(rows, ["journal"], [F.desc_nulls_last("year"), F.col("id").asc()], "place").select("id", "place")


@query("f7_f9_head", "SELECT o_orderkey, o_orderdate::VARCHAR AS day FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def f7(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(20)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))


@query("g2_tagged_union", "SELECT 'val' AS split, l_orderkey, l_tax FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'test', l_orderkey, NULL FROM lineitem WHERE l_linenumber = 2")
def g2(t: Tables) -> DataFrame:
    a = t.lineitem.where("l_linenumber = 1").select(F.lit("val").alias("split"), "l_orderkey", "l_tax")
    return a.unionByName(t.lineitem.where("l_linenumber = 2").select(F.lit("test").alias("split"), "l_orderkey"), allowMissingColumns=True)


@query("g3_g4_sets", "SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS common, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing")
def g3(t: Tables) -> DataFrame:
    common = t.customer.select("c_nationkey").intersect(t.supplier.select("s_nationkey")).agg(F.count("*").alias("common"))
    return common.crossJoin(t.documents.select("doc_id").subtract(t.labels.select("doc_id")).agg(F.count("*").alias("missing")))


@query("g5_distinct_keys", f"SELECT DISTINCT lower(doi) AS doi FROM ({PAPERS}) WHERE doi IS NOT NULL")
def g5(t: Tables) -> DataFrame:
    return t.sql(PAPERS).where("doi is not null").select(F.lower("doi").alias("doi")).distinct()


@query("g6_exact_duplicates", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def g6(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


_KEYS = "SELECT doc_id, sha256(text) AS a, CASE WHEN length(left(text, 40)) >= 30 THEN lower(left(text, 40)) || source END AS b FROM documents"
_CC = f"""WITH RECURSIVE k AS ({_KEYS}), e AS (SELECT x.doc_id AS u, y.doc_id AS v FROM k x JOIN k y ON (x.a = y.a OR x.b = y.b) AND x.doc_id <> y.doc_id),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), g AS (SELECT u AS id, least(u, min(v)) AS grp FROM r GROUP BY u)"""


def _duplicate_groups(t: Tables) -> DataFrame:
    title = F.left("text", F.lit(40))
    keys = {"text": F.sha2("text", 256), "title": F.when(F.length(title) >= 30, F.concat(F.lower(title), "source"))}
    return curation.groups_of(curation.linked_by_keys(t.documents.select("doc_id", "text", "source"), "doc_id", keys))


@query("g7_g8_duplicate_groups", _CC + ' SELECT id, grp AS "group" FROM g')
def g8(t: Tables) -> DataFrame:
    return _duplicate_groups(t)


@query("g9_quarantine", _CC + " SELECT id, grp AS kept FROM g WHERE id <> grp")
def g9(t: Tables) -> DataFrame:
    return _duplicate_groups(t).where("id <> `group`").select("id", F.col("group").alias("kept"))


@query("g11_upsert", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT s_suppkey * 3, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT s_suppkey * 3 FROM supplier)")
def g11(t: Tables) -> DataFrame:
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return curation.upserted(old, t.supplier.select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("name")), ["id"])


@query("g11_upsert_ignore", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 30, s_name FROM supplier WHERE s_suppkey * 30 NOT IN (SELECT c_custkey FROM customer)")
def g11i(t: Tables) -> DataFrame:
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return curation.upserted(old, t.supplier.select((F.col("s_suppkey") * 30).alias("id"), F.col("s_name").alias("name")), ["id"], "ignore")


@query("g12_delete", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def g12(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("g13_key_migration", f"WITH p AS (SELECT id, regexp_replace(replace(coalesce(file_path, ''), chr(92), '/'), '/{{2,}}', '/', 'g') AS path FROM ({PAPERS})) SELECT path, min(id) AS id FROM p GROUP BY path")
def g13(t: Tables) -> DataFrame:
    path = F.regexp_replace(F.replace(F.coalesce("file_path", F.lit("")), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    return curation.first_by_key(t.sql(PAPERS).select("id", path.alias("path")), ["path"], [F.col("id")])


_NEAR = f"""WITH c AS (SELECT cid, mw, logp, sweetness, tpsa FROM ({COMPOUNDS})), s AS (SELECT {', '.join(f"avg({p}) AS m_{p}, coalesce(nullif(stddev_pop({p}), 0), 1) AS s_{p}" for p in ('mw', 'logp', 'sweetness', 'tpsa'))} FROM c),
z AS (SELECT cid, {', '.join(f'(({p} - m_{p}) / s_{p})::DOUBLE AS {p}' for p in ('mw', 'logp', 'sweetness', 'tpsa'))} FROM c, s),
d AS (SELECT a.cid AS target, b.cid, list_filter([{', '.join(f'pow(a.{p} - b.{p}, 2)' for p in ('mw', 'logp', 'sweetness', 'tpsa'))}], lambda x: x IS NOT NULL) AS sq FROM z a, z b WHERE a.cid % 20 = 0 AND a.cid <> b.cid),
r AS (SELECT target, cid, exp(-sqrt(list_sum(sq) / len(sq))) AS similarity FROM d WHERE len(sq) >= 3)
SELECT target, cid, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY target ORDER BY round(similarity, 6) DESC, cid) AS rank FROM r QUALIFY rank <= 12"""


@query("i6_c17_neighbours", _NEAR)
def i6(t: Tables) -> DataFrame:
    rows = t.sql(COMPOUNDS)
    near = compounds.neighbours(rows, rows.where("cid % 20 = 0"), "cid", ["mw", "logp", "sweetness", "tpsa"])
    return near.select("target", "cid", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query("i7_proximity", f"SELECT cid, CASE WHEN sweetness > 0 AND mw > 0 THEN round(exp(-abs(log10(sweetness) - log10(mw))), 5) END AS proximity FROM ({COMPOUNDS})")
def i7(t: Tables) -> DataFrame:
    from quern.functions.numbers import proximity

    return t.sql(COMPOUNDS).select("cid", F.round(proximity(F.col("sweetness"), F.col("mw")), 5).alias("proximity"))


def _bits(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", vectors.sign_words(F.col("embedding")).alias("words"))


_MOLECULES = "SELECT p_partkey AS id, CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'CC(=O)[O-].[Na+]' WHEN 1 THEN 'C[NH3+].[Cl-]' WHEN 2 THEN 'c1ccccc1' WHEN 3 THEN 'CC(=O)O.CCBr.CCO' WHEN 4 THEN ' ' WHEN 5 THEN 'C1CC(' WHEN 6 THEN 'not one!' WHEN 7 THEN '[2H]OC' ELSE '[H+]' END AS smiles FROM {part}"
_HEAVY = f"len(list_filter(regexp_extract_all({{c}}, '{molecules.ATOM}'), lambda x: NOT regexp_matches(x, '{molecules.HYDROGEN}')))"


@query("k1_fragment_text", f"""WITH m AS (SELECT id, trim(smiles, ' ') AS s FROM ({_MOLECULES})),
r AS (SELECT *, CASE WHEN s = '' THEN 'empty' WHEN NOT regexp_matches(s, '{molecules.ALLOWED}') THEN 'characters' WHEN length(replace(s, '(', '')) <> length(replace(s, ')', '')) OR length(replace(s, '[', '')) <> length(replace(s, ']', '')) THEN 'unbalanced' WHEN {_HEAVY.format(c='s')} = 0 THEN 'no heavy atom' END AS reason FROM m),
f AS (SELECT id, reason, unnest(string_split(s, '.')) AS p, generate_subscripts(string_split(s, '.'), 1) AS k FROM r), b AS (SELECT id, reason, arg_max(p, ({_HEAVY.format(c='p')}, length(p), -k)) AS p FROM f GROUP BY id, reason)
SELECT id, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN regexp_replace(p, '{molecules.CHARGED}', '\\1', 'g') END AS canonical, CASE WHEN reason IS NULL THEN {_HEAVY.format(c='p')} END::INT AS atoms FROM b""")
def k1_text(t: Tables) -> DataFrame:
    """What the text of a molecule string tells on its own; ``k1_standardised`` reads it."""
    return t.sql(_MOLECULES).select("id", molecules.standardised(F.col("smiles")).alias("m")).select("id", "m.*")


# a chain of n carbons with an end: acid salt, nitro group, quaternary nitrogen, alcohol and phenyl in two spellings each, ammonium, and strings that are refused
_CHAINS = """SELECT id, kind, n, CASE kind WHEN 0 THEN c || 'C(=O)[O-].[Na+]' WHEN 1 THEN '[O-][N+](=O)' || c WHEN 2 THEN 'C[N+](C)(C)' || c || '.[Cl-]' WHEN 3 THEN 'O' || c WHEN 4 THEN c || 'O' WHEN 5 THEN c || 'c1ccccc1'
  WHEN 6 THEN 'C1=CC=CC=C1' || c WHEN 7 THEN c || '[NH3+]' WHEN 8 THEN ' ' WHEN 9 THEN c || '(' WHEN 10 THEN '[Na+].[Cl-]' ELSE c || '[SiH3]' END AS smiles
FROM (SELECT p_partkey AS id, CAST(p_partkey % 12 AS INT) AS kind, CAST(p_size % 12 + 1 AS INT) AS n, repeat('C', CAST(p_size % 12 + 1 AS INT)) AS c FROM {part})"""
_WORKED = f"""WITH m AS ({_CHAINS}), w AS (SELECT id, kind, n, CASE kind WHEN 3 THEN 4 WHEN 5 THEN 6 ELSE kind END AS class,
  CASE WHEN kind IN (8, 9) THEN 'parse_failed' WHEN kind = 11 THEN 'disallowed_atoms:Si' END AS reason,
  CASE kind WHEN 0 THEN n + 1 WHEN 2 THEN n + 3 WHEN 5 THEN n + 6 WHEN 6 THEN n + 6 WHEN 10 THEN 0 ELSE n END AS nc,
  CASE kind WHEN 0 THEN 2 * n + 2 WHEN 1 THEN 2 * n + 1 WHEN 2 THEN 2 * n + 10 WHEN 5 THEN 2 * n + 6 WHEN 6 THEN 2 * n + 6 WHEN 7 THEN 2 * n + 3 WHEN 10 THEN 1 ELSE 2 * n + 2 END AS nh,
  CASE WHEN kind IN (1, 2, 7) THEN 1 ELSE 0 END AS nn, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS no, CASE WHEN kind = 10 THEN 1 ELSE 0 END AS ncl FROM m)"""


@query("k1_standardised", _WORKED + """, f AS (SELECT *, CASE WHEN nc > 0 THEN 'C' || CASE WHEN nc > 1 THEN nc::VARCHAR ELSE '' END || 'H' || CASE WHEN nh > 1 THEN nh::VARCHAR ELSE '' END || repeat('N', nn) || CASE WHEN no > 0 THEN 'O' ELSE '' END || CASE WHEN no > 1 THEN no::VARCHAR ELSE '' END ELSE 'ClH' END AS formula,
  nc * 12.011 + nh * 1.008 + nn * 14.007 + no * 15.999 + ncl * 35.45 AS weight FROM w)
SELECT id, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN formula END AS formula, CASE WHEN reason IS NULL THEN round(weight, 3)::DOUBLE END AS weight, CASE WHEN reason IS NULL THEN (nc + nn + no + ncl)::INT END AS n_heavy_atoms,
  CASE WHEN reason IS NULL THEN (kind = 2)::INT END AS charge, CASE WHEN reason IS NULL THEN min(id) OVER (PARTITION BY reason, CASE WHEN kind = 10 THEN 0 ELSE n END, class) END AS same_as FROM f""")
def k1(t: Tables) -> DataFrame:
    """Molecule strings read, stripped of salts and uncharged; molecules that are equal, however written, name the smallest id among them."""
    found = molecule_tables.standardised(t.sql(_CHAINS), "id", "smiles")
    least = found.where("valid").groupBy("key").agg(F.min("id").alias("same_as"))
    return found.join(least, "key", "left").select("id", "valid", "reason", "formula", F.round("weight", 3).alias("weight"), "n_heavy_atoms", "charge", "same_as")


@query("k2_descriptors", _WORKED + """ SELECT id, round(nc * 12.011 + nh * 1.008 + nn * 14.007 + no * 15.999 + ncl * 35.45, 3)::DOUBLE AS weight, nc + nn + no + ncl AS n_heavy, nc + nn + no + ncl - 1 + (class = 6)::INT AS n_bonds, (class = 6)::INT AS n_rings,
  (kind IN (0, 3, 4, 7))::INT AS donors, nn + no AS acceptors, CASE WHEN kind = 10 THEN 0 WHEN kind IN (3, 4, 7) THEN greatest(n - 2, 0) ELSE n - 1 END AS rotatable, 6 * (class = 6)::INT AS aromatic,
  CASE WHEN kind = 0 THEN round(n / (n + 1), 6) WHEN class = 6 THEN round(n / (n + 6), 6) WHEN kind = 10 THEN 0 ELSE 1 END::DOUBLE AS share_sp3, (kind = 2)::INT AS charge FROM w WHERE reason IS NULL""")
def k2_descriptors(t: Tables) -> DataFrame:
    """Simple descriptors of all molecules that can be read; failed rows are dropped."""
    found = molecule_tables.standardised(t.sql(_CHAINS), "id", "smiles").where("valid")
    made = found.select("id", molecule_tables.descriptors(F.col("atoms")).alias("d")).select("id", "d.*")
    return made.withColumns({"weight": F.round("weight", 3), "share_sp3": F.round("share_sp3", 6)})


@query("k2_circular_fingerprints")
def k2(t: Tables) -> DataFrame:
    """Set bits of 1,024 by neighbourhoods of up to two bonds, as 64-bit words, of all molecules that can be read."""
    found = molecule_tables.circular_bits(molecule_tables.standardised(t.sql(_CHAINS), "id", "smiles").where("valid"))
    return found.select("id", F.size("bits").alias("n_bits"), F.array_join(molecule_tables.words(F.col("bits")).cast("array<string>"), ",").alias("words"))


@query("i9_chemical_space")
def i9(t: Tables) -> DataFrame:
    return compounds.chemical_space(_bits(t), "vec_id", "words")


_word = lambda low: "(" + " | ".join(f"(CASE WHEN embedding[{low + i + 1}] > 0 THEN {1 << i} ELSE 0 END)::BIGINT" for i in range(32)) + ")"
_WORDS = f"SELECT vec_id, {_word(0)} AS v, {_word(32)} AS w FROM embeddings"
_DISTANCE = "round(CASE WHEN bit_count(a.v | b.v) + bit_count(a.w | b.w) = 0 THEN 0.0 ELSE 1 - (bit_count(a.v & b.v) + bit_count(a.w & b.w)) / (bit_count(a.v | b.v) + bit_count(a.w | b.w))::DOUBLE END, 6)"


@query("c18_landmark_distances", f"WITH b AS ({_WORDS}) SELECT b.vec_id, a.vec_id AS landmark, {_DISTANCE} AS distance FROM b a, b WHERE a.vec_id < 64")
def c18(t: Tables) -> DataFrame:
    """Fingerprint distances of all rows to a bounded set of them."""
    points = _bits(t)
    far = compounds.landmark_distances(points, points.where("vec_id < 64"), "vec_id", "words")
    return far.select("vec_id", "landmark", F.round("distance", 6).alias("distance"))


@query("h47_bit_operations", f"WITH b AS ({_WORDS}) SELECT vec_id, (bit_count(v) + bit_count(w))::INT AS ones, (v & 65535)::BIGINT AS low, (w | 1)::BIGINT AS odd FROM b")
def h47(t: Tables) -> DataFrame:
    v, w = F.get("words", 0), F.get("words", 1)
    return _bits(t).select("vec_id", (F.bit_count(v) + F.bit_count(w)).alias("ones"), v.bitwiseAND(F.lit(65535)).alias("low"), w.bitwiseOR(F.lit(1)).alias("odd"))


@query("i10_fuzzy_names")
def i10(t: Tables) -> DataFrame:
    return compounds.fuzzy(t.part, "p_partkey", ["p_name", "p_brand", "p_type"], "red wigdet")


@query("n1_n3_vector_counts", "SELECT 'repeated ids' AS violation, count(*) - count(DISTINCT vec_id) AS n FROM embeddings UNION ALL SELECT 'without vector', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'wrong dimension', count(*) FROM embeddings WHERE len(embedding) <> 64")
def n1(t: Tables) -> DataFrame:
    return checks.index_report(t.embeddings, t.documents, "vec_id", "doc_id", "embedding", 64)


_MANIFEST = "SELECT count(*) AS vector_count, count(*) + 1 AS chunk_count, 3 AS orphan_vector_count, count(*) + 3 AS vectors_seen FROM {embeddings}"


@query("n2_release_checks", """WITH v AS (SELECT count(*) AS v FROM embeddings), c AS (SELECT count(*) AS c, count(e.vec_id) AS m FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)
SELECT unnest(['vectors = mapped = chunks', 'manifest vectors', 'manifest chunks', 'seen = indexed + orphans']) AS rule, unnest([v = m AND m = c, true, v + 1 = c, true]) AS holds FROM v, c""")
def n2(t: Tables) -> DataFrame:
    ids = t.embeddings.select("vec_id").distinct()
    chunks = t.documents.join(ids, F.col("doc_id") == F.col("vec_id"), "left")
    return checks.release_report(t.embeddings, chunks, t.sql(_MANIFEST), "vec_id", "vec_id")


@query("n4_catalog_rules", f"WITH p AS ({PAPERS}) SELECT id, CASE WHEN coalesce(file_path, '') = '' THEN 'no path' WHEN trim(coalesce(title, ''), ' ') = '' THEN 'no title' WHEN contains(file_path, chr(92)) THEN 'path not canonical' END AS violation FROM p WHERE coalesce(file_path, '') = '' OR trim(coalesce(title, ''), ' ') = '' OR contains(file_path, chr(92))")
def n4(t: Tables) -> DataFrame:
    rules = {"no path": F.coalesce("file_path", F.lit("")) == "", "no title": F.trim(F.coalesce("title", F.lit(""))) == "", "path not canonical": F.contains("file_path", F.lit("\\"))}
    return checks.violations(t.sql(PAPERS), "id", rules)


@query("n5_gold_rules", "SELECT doc_id, CASE WHEN quality NOT IN (0, 1) THEN 'quality' WHEN toxic = 1 AND quality = 1 THEN 'approved but toxic' END AS violation FROM labels WHERE quality NOT IN (0, 1) OR (toxic = 1 AND quality = 1)")
def n5(t: Tables) -> DataFrame:
    return checks.violations(t.labels, "doc_id", {"quality": ~F.col("quality").isin(0, 1), "approved but toxic": (F.col("toxic") == 1) & (F.col("quality") == 1)})


@query("n7_a22_identity", "SELECT 'gone' AS change, count(*) AS n FROM (SELECT doc_id, sha256(coalesce(text, '')) FROM documents EXCEPT SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE coalesce(text, '') END) FROM documents WHERE doc_id % 10 <> 3) UNION ALL SELECT 'new', count(*) FROM (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE coalesce(text, '') END) FROM documents WHERE doc_id % 10 <> 3 EXCEPT SELECT doc_id, sha256(coalesce(text, '')) FROM documents)")
def n7(t: Tables) -> DataFrame:
    """A second manifest that lacks some files and has others changed."""
    text = F.coalesce("text", F.lit(""))
    files = t.documents.select("doc_id", F.sha2(text, 256).alias("digest"))
    later = t.documents.where("doc_id % 10 <> 3").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, "x").otherwise(text), 256).alias("digest"))
    return checks.changes(files, later)


@query("n8_unique_and_bounded", "SELECT count(*) - count(DISTINCT p_partkey) AS repeated, count(*) FILTER (NOT p_size BETWEEN 0 AND 50) AS outside FROM part")
def n8(t: Tables) -> DataFrame:
    return t.part.agg((F.count("*") - F.count_distinct("p_partkey")).alias("repeated"), F.count_if(~F.col("p_size").between(0, 50)).alias("outside"))
