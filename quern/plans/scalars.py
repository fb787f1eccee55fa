"""Queries of column functions: text, citations, paths, numbers, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import citations, numbers, paths, text
from quern.plans.base import Tables, query
from quern.plans.proxies import ANSWERS, COMPOUNDS, PAPERS, REQUESTS

_MISSING = "(" + ", ".join(f"'{m}'" for m in text.MISSING) + ")"


@query("h2_blank_to_null", "SELECT doc_id, nullif(trim(translate(left(text, 2000000), chr(160), ' '), ' '), '') IS NULL AS blank, length(trim(translate(text, chr(160), ' '), ' ')) AS n FROM documents")
def h2(t: Tables) -> DataFrame:
    c = text.blank_to_null(F.col("text"))
    return t.documents.select("doc_id", c.isNull().alias("blank"), F.coalesce(F.length(c), F.length(F.trim(F.translate("text", text.NBSP, " ")))).cast("bigint").alias("n"))


@query("h3_collapse_space", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS digest FROM documents")
def h3(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.collapse_space(F.col("text")), 256).alias("digest"))


@query("h4_strip_space", r"SELECT doc_id, sha256(lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g'))) AS digest FROM documents")
def h4(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.strip_space(F.col("text")), 256).alias("digest"))


@query("h5_catalog_text", rf"WITH p AS ({PAPERS}), c AS (SELECT id, trim(regexp_replace(regexp_replace(coalesce(title, ''), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), ' ') AS v FROM p) SELECT id, CASE WHEN lower(v) IN {_MISSING} THEN '' ELSE v END AS title FROM c")
def h5(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", text.catalog_text(F.col("title"), unicode=False).alias("title"))


@query("h5_catalog_text_unicode")
def h5u(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.catalog_text(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


@query("j25_page_text", r"SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def j25(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(text.strip_tags(F.col("html")), 256).alias("digest"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


_AUTHORS = "list_filter(list_transform(CASE WHEN contains(authors, ';') THEN string_split(authors, ';') WHEN contains(authors, ',') THEN string_split(authors, ',') WHEN contains(authors, ' and ') THEN string_split(authors, ' and ') WHEN contains(authors, '&') THEN string_split(authors, '&') ELSE [authors] END, lambda x: trim(x, ' ')), lambda x: length(x) > 2)[1:10]"


@query("h6_h18_authors", f"WITH p AS ({PAPERS}) SELECT id, array_to_string({_AUTHORS}, '|') AS names FROM p")
def h18(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", F.array_join(text.authors_of(F.col("authors")), "|").alias("names"))


_DOI = r"""regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(trim(coalesce({c}, ''), ' '), '(?i)^https?://(?:dx\.)?doi\.org/', ''), '(?i)^doi\s*:\s*', ''),
  '(?i)10\.\d{{4,9}}/[-._;()/:A-Z0-9]+'), '[.,;:)\]}}]+$', ''), '(?i)/-/DCSupplemental$', ''), '(?i)^(10\.1093/[^/]+/[^/]+)/\d+$', '\1')"""


@query("h7_doi", f"WITH p AS ({PAPERS}) SELECT id, {_DOI.format(c='doi')} AS doi FROM p")
def h7(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", text.doi_of(F.col("doi")).alias("doi"))


@query("h8_title_keys", f"WITH p AS ({PAPERS}) SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' ') AS spaced, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS joined FROM p")
def h8(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", text.title_key(F.col("title")).alias("spaced"), text.title_key(F.col("title"), "").alias("joined"))


_PRESENT = "(CASE WHEN lower(trim(coalesce({c}, ''), ' ')) IN " + _MISSING + " THEN '' ELSE trim(coalesce({c}, ''), ' ') END)"
_PART = "regexp_replace(" + _PRESENT + ", '[ .,;:]+$', '')"


@query("h9_citation", rf"""WITH p AS ({PAPERS}), a AS (SELECT *, list_filter(list_transform({_AUTHORS}, lambda x: {_PART.format(c='x')}), lambda x: x <> '') AS names FROM p),
f AS (SELECT id, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ', et al' ELSE '' END AS who,
  coalesce(nullif({_PART.format(c='title')}, ''), nullif({_PART.format(c='filename')}, ''), 'Untitled') AS name, {_PART.format(c='journal')} AS j, {_PRESENT.format(c='year')} AS y, {_PRESENT.format(c='volume')} AS v,
  {_PRESENT.format(c='issue')} AS i, {_PRESENT.format(c='pages')} AS g, {_DOI.format(c=_PRESENT.format(c='doi'))} AS d FROM a)
SELECT id, trim(regexp_replace(CASE WHEN who <> '' THEN who || '. ' ELSE '' END || name || '[J]' || CASE WHEN j <> '' THEN '. ' || j ELSE '' END || CASE WHEN y <> '' THEN ', ' || y ELSE '' END
  || CASE WHEN v <> '' THEN ', ' || v ELSE '' END || CASE WHEN i <> '' THEN '(' || i || ')' ELSE '' END || CASE WHEN g <> '' THEN ': ' || g ELSE '' END || '.' || CASE WHEN d <> '' THEN ' DOI: ' || d || '.' ELSE '' END, '\s+', ' ', 'g'), ' ') AS citation FROM f""")
def h9(t: Tables) -> DataFrame:
    c = citations.gbt7714(text.authors_of(F.col("authors")), *[F.col(k) for k in ("title", "filename", "journal", "year", "volume", "issue", "pages", "doi")])
    return t.sql(PAPERS).select("id", c.alias("citation"))


@query("h10_article_url", rf"WITH p AS ({PAPERS}), d AS (SELECT *, {_DOI.format(c='doi')} AS d FROM p) SELECT id, CASE WHEN d <> '' THEN 'https://doi.org/' || d WHEN regexp_matches(pubmed, '^[0-9]+$') THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pubmed || '/' END AS url FROM d")
def h10(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", citations.article_url(F.col("doi"), F.col("pubmed")).alias("url"))


_STEM = r"regexp_replace(regexp_extract(filename, '[^/]*$'), '(.)\.[^.]*$', '\1')"
_NAME = r"'^(.+?)\s*(?:等|et al\.?|and others)?\s*-\s*(\d{4})\s*-\s*(.+)$'"


@query("h11_name_grammar", f"WITH p AS (SELECT id, {_STEM} AS s FROM ({PAPERS})) SELECT id, CASE WHEN regexp_matches(s, {_NAME}) THEN trim(regexp_extract(s, {_NAME}, 1), ' ') END AS author, CASE WHEN regexp_matches(s, {_NAME}) THEN regexp_extract(s, {_NAME}, 2) END AS year, CASE WHEN regexp_matches(s, {_NAME}) THEN trim(regexp_extract(s, {_NAME}, 3), ' ') END AS title FROM p")
def h11(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", paths.from_name(F.col("filename")).alias("n")).select("id", "n.author", "n.year", "n.title")


def _moved_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN instr({c}, '{a}') > 0 THEN '{b}' || substr({c}, instr({c}, '{a}') + {len(a)})" for a, b in paths.MOVED) + f" ELSE {c} END"


_CANON = (
    "WITH p AS (SELECT id, regexp_replace(replace(coalesce(file_path, ''), chr(92), '/'), '/{2,}', '/', 'g') AS p FROM (" + PAPERS + ")), c AS (SELECT id, CASE WHEN NOT starts_with(p, '/') THEN " + _moved_sql("p")
    + " WHEN starts_with(p, '/srv/app/') THEN " + _moved_sql("substr(p, 10)") + " " + " ".join(f"WHEN instr(p, '{a}') > 0 THEN {_moved_sql(f'substr(p, instr(p, {chr(39)}{a}{chr(39)}))')}" for a in paths.ANCHORS) + " ELSE regexp_extract(p, '[^/]*$') END AS path FROM p) "
)


@query("h12_canonical_path", _CANON + "SELECT * FROM c")
def h12(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", paths.canonical(F.col("file_path"), "/srv/app").alias("path"))


@query("id_document_and_chunk", _CANON + ", d AS (SELECT id, substr(sha256(coalesce(nullif(path, ''), 'unknown')), 1, 24) AS document_id FROM c) SELECT id, document_id, substr(sha256(document_id || ':' || trim(regexp_replace(p_name, '\\s+', ' ', 'g'), ' ')), 1, 24) AS chunk_id FROM d JOIN part ON id = p_partkey")
def ids(t: Tables) -> DataFrame:
    d = t.sql(PAPERS).select("id", paths.document_id(paths.canonical(F.col("file_path"), "/srv/app")).alias("document_id"))
    j = d.join(t.part, F.col("id") == F.col("p_partkey"))
    return j.select("id", "document_id", paths.chunk_id(F.col("document_id"), F.col("p_name")).alias("chunk_id"))


@query("h13_name_parts", rf"WITH p AS ({PAPERS}) SELECT id, regexp_extract(file_path, '[^/]*$') AS base, regexp_replace(regexp_extract(file_path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '.(\.[^.]*)$', 1)) AS ext FROM p")
def h13(t: Tables) -> DataFrame:
    c = F.col("file_path")
    return t.sql(PAPERS).select("id", paths.basename(c).alias("base"), paths.stem(c).alias("stem"), paths.extension(c).alias("ext"))


@query("h14_years", rf"WITH p AS ({PAPERS}) SELECT id, TRY_CAST(regexp_extract(year, '(19|20)\d{{2}}') AS INT) AS first_year, regexp_extract_all(filename, '\b(?:19|20)\d{{2}}\b')[-1] AS last_year FROM p")
def h14(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", text.year_of(F.col("year")).alias("first_year"), text.last_year_of(F.col("filename")).alias("last_year"))


_PAGE = "(SELECT p_partkey AS id, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'Vol. ' || CAST(p_size AS STRING) || ' (' || CAST(p_partkey % 9 AS STRING) || ') pp. 12 - 34' WHEN 1 THEN 'volume  7, no. 3; pages: A1–A9' WHEN 2 THEN p_name ELSE '45(6) page 7' END AS t FROM {part})"


@query("h15_volume_issue_pages", rf"""WITH p AS (SELECT id, regexp_replace(t, '\s+', ' ', 'g') AS t FROM {_PAGE}), b AS (SELECT *, '(?i)\b(?:vol(?:ume)?\.?\s*)?(\d{{1,4}})\s*\(\s*(\d{{1,4}})\s*\)' AS r FROM p)
SELECT id, nullif(CASE WHEN regexp_matches(t, '(?i)\b(?:vol(?:ume)?\.?\s*)?(\d{{1,4}})\s*\(\s*(\d{{1,4}})\s*\)') THEN regexp_extract(t, '(?i)\b(?:vol(?:ume)?\.?\s*)?(\d{{1,4}})\s*\(\s*(\d{{1,4}})\s*\)', 1) ELSE regexp_extract(t, '(?i)\bvol(?:ume)?\.?\s*(\d{{1,4}})\b', 1) END, '') AS volume,
nullif(CASE WHEN regexp_matches(t, '(?i)\b(?:vol(?:ume)?\.?\s*)?(\d{{1,4}})\s*\(\s*(\d{{1,4}})\s*\)') THEN regexp_extract(t, '(?i)\b(?:vol(?:ume)?\.?\s*)?(\d{{1,4}})\s*\(\s*(\d{{1,4}})\s*\)', 2) ELSE regexp_extract(t, '(?i)\b(?:issue|no\.)\s*(\d{{1,4}})\b', 1) END, '') AS issue,
nullif(replace(replace(regexp_extract(t, '(?i)\b(?:pages?|pp\.?)[ :]+([A-Za-z]?\d{{1,6}}\s*[-–]\s*[A-Za-z]?\d{{1,6}})\b', 1), '–', '-'), ' ', ''), '') AS pages FROM b""")
def h15(t: Tables) -> DataFrame:
    c = F.col("t")
    v, i = text.volume_issue(c)
    return t.sql(f"SELECT * FROM {_PAGE}").select("id", v.alias("volume"), i.alias("issue"), text.pages_of(c).alias("pages"))


@query("h16_title_lines", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:15], lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 20 AND 300 AND NOT regexp_matches(lower(x), 'doi:|http|www|©|copyright|published|received')) AS g FROM documents)
SELECT doc_id, CASE WHEN NOT suffix(g[1], '.') AND regexp_matches(g[2], '^\p{Lu}') THEN g[1] || ' ' || g[2] ELSE g[1] END AS title FROM l""")
def h16(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.title_from_lines(F.col("text")).alias("title"))


@query("h19_citation_noise", rf"WITH a AS ({ANSWERS}) SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, '\[\d+\]', '', 'g'), '(?i)\[CrossRef\]|\[PubMed\]|\[Google Scholar\]', '', 'g'), '(?m)^\d+\.\s+', '', 'g'), '\s+', ' ', 'g'), ' ') AS answer FROM a")
def h19(t: Tables) -> DataFrame:
    return t.sql(ANSWERS).select("id", text.citation_noise_removed(F.col("answer")).alias("answer"))


_IDS = r"list_transform(regexp_extract_all(answer, 'ref_\d+'), lambda x: x)"


@query("h20_citation_diagnosis", rf"WITH a AS ({ANSWERS}) SELECT id, coalesce(array_to_string(list_sort(list_distinct({_IDS})), ','), '') AS cited, coalesce(array_to_string(list_sort(list_filter(list_distinct({_IDS}), lambda x: x NOT IN ('ref_1', 'ref_2'))), ','), '') AS invalid FROM a")
def h20(t: Tables) -> DataFrame:
    ids = text.citation_ids(F.col("answer"))
    valid = F.array(F.lit("ref_1"), F.lit("ref_2"))
    return t.sql(ANSWERS).select("id", F.array_join(F.array_sort(ids), ",").alias("cited"), F.array_join(F.array_sort(F.array_except(ids, valid)), ",").alias("invalid"))


_GROUP = r"\[(?:ref_\d+\s*,\s*)*ref_\d+\]"
#: Pieces of an answer round its groups of citations, numbered; a group's ids as a list.
_CUT = f"SELECT id, unnest(list_concat(string_split_regex(answer, '{_GROUP}'), [])) AS gap, generate_subscripts(string_split_regex(answer, '{_GROUP}'), 1) AS k, regexp_extract_all(answer, '{_GROUP}') AS groups FROM a"
_IDS = "string_split_regex(regexp_replace(groups[k], '[\\[\\]]', '', 'g'), '\\s*,\\s*')".replace("\\\\", "\\")


@query("h20_citations_kept", f"""WITH a AS ({ANSWERS}), c AS ({_CUT}), g AS (SELECT id, k, gap, CASE WHEN k <= len(groups) THEN list_filter({_IDS}, lambda x: x IN ('ref_1', 'ref_2')) ELSE [] END AS ids FROM c)
SELECT id, regexp_replace(string_agg(gap || CASE WHEN len(ids) > 0 THEN '[' || array_to_string(ids, ', ') || ']' ELSE '' END, '' ORDER BY k), ' {{2,}}', ' ', 'g') AS answer FROM g GROUP BY id""")
def h20k(t: Tables) -> DataFrame:
    return t.sql(ANSWERS).select("id", text.citations_kept(F.col("answer"), F.array(F.lit("ref_1"), F.lit("ref_2"))).alias("answer"))


@query("h21_h22_answer_tests", rf"WITH a AS ({ANSWERS}) SELECT id, regexp_matches(answer, '\[ref_\d+') AS cited, ({' OR '.join(f'contains(lower(answer), {chr(39)}{m}{chr(39)})' for m in text.REFUSALS)}) AS refused FROM a")
def h22(t: Tables) -> DataFrame:
    return t.sql(ANSWERS).select("id", F.regexp_like("answer", F.lit(r"\[ref_\d+")).alias("cited"), text.is_refusal(F.col("answer")).alias("refused"))


_WORDS = ["sweet", "honey", "cited", "again"]


@query("h23_keyword_hit_rate", rf"WITH a AS ({ANSWERS}) SELECT id, ({' + '.join(f'CAST(contains(lower(answer), {chr(39)}{w}{chr(39)}) AS INT)' for w in _WORDS)}) / {len(_WORDS)}.0 AS hit_rate FROM a")
def h23(t: Tables) -> DataFrame:
    return t.sql(ANSWERS).select("id", (text.count_contained(F.col("answer"), _WORDS) / F.lit(float(len(_WORDS)))).alias("hit_rate"))


@query("h24_smiles_candidates", f"WITH r AS ({REQUESTS}) SELECT id, coalesce(array_to_string(list_filter(regexp_extract_all(text, '{text.SMILES}'), lambda x: x NOT IN ({', '.join(map(repr, text.SMILES_STOP))})), ' '), '') AS found FROM r")
def h24(t: Tables) -> DataFrame:
    return t.sql(REQUESTS).select("id", F.array_join(text.smiles_candidates(F.col("text")), " ").alias("found"))


_STATED = (
    {k: f"TRY_CAST(regexp_extract(text, '(?i){p}', 1) AS DOUBLE)" for k, p in text.PARAMETERS.items()}
    | {k: f"TRY_CAST(regexp_extract(text, '(?i){p}', 1) AS INT)" for k, p in text.COUNTS.items()}
    | {k: "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{v}'" for p, v in options) + " END" for k, options in text.CHOICES.items()}
)
_ANY_STATED = "coalesce(" + ", ".join(f"({c})::VARCHAR" for c in _STATED.values()) + ") IS NOT NULL"


@query("h25_parameters", f"WITH r AS ({REQUESTS}) SELECT id, " + ", ".join(f"{c} AS {k}" for k, c in _STATED.items()) + " FROM r")
def h25(t: Tables) -> DataFrame:
    return t.sql(REQUESTS).select("id", *[c.alias(k) for k, c in text.parameters_of(F.col("text")).items()])


@query("h26_intent", rf"WITH r AS ({REQUESTS}) SELECT id, CASE WHEN regexp_matches(text, '{text.TROUBLE}') THEN 'troubleshooting' WHEN regexp_matches(text, '{text.SETUP}') OR ({_ANY_STATED} AND NOT regexp_matches(text, '{text.ASKING}')) THEN 'setup' ELSE 'general' END AS intent FROM r")
def h26(t: Tables) -> DataFrame:
    return t.sql(REQUESTS).select("id", text.intent_of(F.col("text")).alias("intent"))


@query("h27_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def h27(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("h28_copy_mark", rf"WITH p AS (SELECT id, {_STEM} AS s FROM ({PAPERS})) SELECT id, trim(regexp_replace(s, '(?i)[\s_-]*(?:\(\d+\)|copy|副本)$', ''), ' ') AS stem FROM p")
def h28(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", paths.without_copy_mark(paths.stem(F.col("filename"))).alias("stem"))


@query("h29_h30_arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CAST(ceil(l_quantity / 7) AS BIGINT) AS packs, CAST(floor(l_extendedprice / 100) AS BIGINT) AS hundreds, round(log10(l_extendedprice), 6) AS magnitude, round(sqrt(l_quantity) + exp(-l_discount), 6) AS mixed FROM lineitem")
def h30(t: Tables) -> DataFrame:
    e, q, d = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(e * (1 - d), 4).alias("net"), F.ceil(q / 7).alias("packs"), F.floor(e / 100).alias("hundreds"), F.round(F.log10(e), 6).alias("magnitude"), F.round(F.sqrt(q) + F.exp(-d), 6).alias("mixed"))


@query("h31_h32_sweetness", "WITH x AS (SELECT l_orderkey, l_linenumber, (least(greatest(l_quantity - 40.0, -25.0), 15.0) + 20.72) / 10.13 AS ls, l_discount * 10 AS p FROM lineitem) SELECT l_orderkey, l_linenumber, round(ls, 9) AS log_sw, round(pow(10, ls), 1) AS sw, CASE WHEN abs(p - 0.5) > 0.3 THEN 'high' WHEN abs(p - 0.5) > 0.15 THEN 'medium' ELSE 'low' END AS confidence FROM x")
def h31(t: Tables) -> DataFrame:
    ls = numbers.log_sweetness(F.col("l_quantity") - 40.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(ls, 9).alias("log_sw"), F.round(F.pow(F.lit(10.0), ls), 1).alias("sw"), numbers.confidence(F.col("l_discount") * 10).alias("confidence"))


@query("h33_h34_loads", "SELECT doc_id, greatest(1, CAST(round(0.000602214 * 0.15 * length(text)) AS INT)) AS pairs, ceil(length(text) / 462) + 10 * (doc_id % 3) + 10000 * (doc_id % 2) AS pressure, floor(length(text) / 3) AS tokens FROM documents")
def h33(t: Tables) -> DataFrame:
    n = F.length("text")
    return t.documents.select("doc_id", numbers.salt_pairs(F.lit(0.15), n).alias("pairs"), numbers.pressure(n, F.col("doc_id") % 3, F.col("doc_id") % 2).cast("double").alias("pressure"), F.floor(n / 3).cast("double").alias("tokens"))


_AS_OF = 2026


@query("h40_recency", rf"WITH p AS (SELECT id, TRY_CAST(regexp_extract(year, '(19|20)\d{{2}}') AS INT) AS y FROM ({PAPERS})) SELECT id, CASE WHEN y IS NULL THEN 3.0 WHEN {_AS_OF} - y <= 2 THEN 5.0 WHEN {_AS_OF} - y <= 5 THEN 4.0 WHEN {_AS_OF} - y <= 10 THEN 3.0 WHEN {_AS_OF} - y <= 20 THEN 2.0 ELSE 1.0 END::DOUBLE AS recency FROM p")
def h40(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", numbers.recency(text.year_of(F.col("year")), _AS_OF).alias("recency"))


@query("h39_expiry", "SELECT event_id, CAST(ts + INTERVAL 24 HOURS AS VARCHAR) AS expires, ts + INTERVAL 24 HOURS < TIMESTAMP '2024-01-15 00:00:00' AS expired FROM events")
def h39(t: Tables) -> DataFrame:
    e = F.expr("ts + INTERVAL 24 HOURS")
    shown = F.regexp_replace(F.date_format(e, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    shown = F.when(F.regexp_like(F.date_format(e, "SSSSSS"), F.lit("^0+$")), F.date_format(e, "yyyy-MM-dd HH:mm:ss")).otherwise(shown)
    return t.events.select("event_id", shown.alias("expires"), (e < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("expired"))


@query("h42_lists", r"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(string_split(lower(text), ' '))), ' ') AS words, len(string_split(text, ' ')) AS n, array_to_string(string_split(text, ' ')[1:5], ' ') AS lead FROM conversations")
def h42(t: Tables) -> DataFrame:
    w = F.split("text", " ")
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("text"), " "))), " ").alias("words"), F.size(w).cast("bigint").alias("n"), F.array_join(F.slice(w, 1, 5), " ").alias("lead"))


@query("h45_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, to_json(struct_pack(user_id := user_id, event_type := event_type))::VARCHAR AS packed FROM events")
def h45(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct("user_id", "event_type")).alias("packed"))


@query("h46_h44_defaults", f"WITH p AS ({PAPERS}) SELECT id, coalesce(nullif(title, ' '), filename) AS title, coalesce(journal, 'Unknown Journal') AS journal, coalesce(year, 'N/A') AS year FROM p")
def h46(t: Tables) -> DataFrame:
    defaults = {"journal": "Unknown Journal", "year": "N/A"}
    return t.sql(PAPERS).select("id", F.coalesce(F.nullif("title", F.lit(" ")), "filename").alias("title"), *[F.coalesce(k, F.lit(v)).alias(k) for k, v in defaults.items()])


@query("h48_sha", "SELECT doc_id, sha256(text) AS full_digest, substr(sha256(text), 1, 16) AS short FROM documents")
def h48(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("full_digest"), F.substring(F.sha2("text", 256), 1, 16).alias("short"))


@query("h49_chain_remap", "WITH n AS (SELECT n_regionkey AS g, list(n_name ORDER BY n_nationkey) AS own FROM nation GROUP BY ALL), u AS (SELECT g, own, list_filter(['NATION_0', 'NATION_3', 'A', 'B', 'C', 'D', 'E', 'F', 'G', 'H'], lambda x: NOT list_contains(own, x)) AS free FROM n) SELECT g, unnest(own) AS chain, unnest(free[1:len(own)]) AS new FROM u")
def h49(t: Tables) -> DataFrame:
    ids = F.array(*[F.lit(x) for x in ("NATION_0", "NATION_3", "A", "B", "C", "D", "E", "F", "G", "H")])
    own = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"])
    g = t.nation.groupBy(F.col("n_regionkey").alias("g")).agg(own.alias("own"))
    pairs = F.arrays_zip("own", F.slice(F.array_except(ids, F.col("own")), 1, F.size("own")).alias("free"))
    return g.select("g", F.explode(pairs).alias("z")).select("g", F.col("z.own").alias("chain"), F.col("z.free").alias("new"))


@query("b1_rename", "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, p_size, p_brand, p_type FROM part")
def b1(t: Tables) -> DataFrame:
    return t.part.withColumnsRenamed({"p_partkey": "id", "p_name": "name", "p_retailprice": "price", "absent": "other"})


@query("b2_b3_coercion", f"WITH c AS ({COMPOUNDS}) SELECT cid, coalesce(TRY_CAST(mw_text AS DOUBLE), 0) AS zeroed, TRY_CAST(nullif(trim(mw_text, ' '), '') AS DOUBLE) AS nulled FROM c")
def b2(t: Tables) -> DataFrame:
    return t.sql(COMPOUNDS).select("cid", numbers.number_or_zero(F.col("mw_text")).alias("zeroed"), numbers.number_or_null(F.col("mw_text")).alias("nulled"))


@query("b4_curated", f"WITH c AS (SELECT cid, trim(formula, ' ') AS f FROM ({COMPOUNDS})) SELECT cid, CASE WHEN f = '' OR regexp_matches(f, '(?i)placeholder|dummykey|^n/a$') THEN NULL ELSE f END AS formula FROM c")
def b4(t: Tables) -> DataFrame:
    return t.sql(COMPOUNDS).select("cid", text.curated(F.col("formula")).alias("formula"))


@query("b5_b6_first_present", f"WITH p AS ({PAPERS}) SELECT id, coalesce(nullif(trim(title, ' '), ''), nullif(trim(journal, ' '), ''), nullif(trim(filename, ' '), '')) AS label FROM p")
def b5(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", text.first_present(F.col("title"), F.col("journal"), F.col("filename")).alias("label"))


@query("b8_b11_maps", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS done, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' END AS confidence FROM orders")
def b8(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", text.mapped(F.col("o_orderstatus"), {"F": 1, "O": 0}).alias("done"), text.mapped(F.col("o_orderpriority"), {"1-URGENT": "high", "2-HIGH": "high", "5-LOW": "low"}).alias("confidence"))


@query("b12_range_report", "SELECT count(*) AS total, count(*) FILTER (p_retailprice < 950) AS below, count(*) FILTER (p_retailprice > 1000) AS above, count(*) FILTER (p_retailprice BETWEEN 950 AND 1000) AS kept FROM part")
def b12(t: Tables) -> DataFrame:
    c = F.col("p_retailprice")
    return t.part.agg(F.count("*").alias("total"), F.count_if(c < 950).alias("below"), F.count_if(c > 1000).alias("above"), F.count_if(c.between(950, 1000)).alias("kept"))


@query("b13_nullable_range", f"WITH c AS ({COMPOUNDS}) SELECT cid, coalesce(sweetness >= 100, false) AS low_only, coalesce(sweetness BETWEEN 50 AND 500, false) AS both_ends, true AS open FROM c")
def b13(t: Tables) -> DataFrame:
    c = F.col("sweetness")
    return t.sql(COMPOUNDS).select("cid", numbers.in_range(c, 100, None).alias("low_only"), numbers.in_range(c, 50, 500).alias("both_ends"), numbers.in_range(c, None, None).alias("open"))


@query("b14_b15_search", f"WITH c AS ({COMPOUNDS}) SELECT cid, name FROM c WHERE contains(lower(concat_ws(' ', name, CAST(cid AS STRING), formula)), 'ring')")
def b14(t: Tables) -> DataFrame:
    return t.sql(COMPOUNDS).where(F.contains(F.lower(F.concat_ws(" ", "name", F.col("cid").cast("string"), "formula")), F.lit("ring"))).select("cid", "name")


@query("b16_any_term", f"WITH p AS ({PAPERS}) SELECT id FROM p WHERE contains(lower(concat_ws(' ', title, journal, doi, filename, authors)), 'bolt') OR contains(lower(concat_ws(' ', title, journal, doi, filename, authors)), 'nature')")
def b16(t: Tables) -> DataFrame:
    return t.sql(PAPERS).where(text.contains_any(F.concat_ws(" ", "title", "journal", "doi", "filename", "authors"), ["bolt", "nature"])).select("id")


@query("b19_b23_valid_rows", "SELECT doc_id FROM documents WHERE text <> '' AND regexp_matches(substr(sha256(text), 1, 24), '^[0-9a-f]{24}$')")
def b19(t: Tables) -> DataFrame:
    return t.documents.where((F.col("text") != "") & F.regexp_like(F.substring(F.sha2("text", 256), 1, 24), F.lit("^[0-9a-f]{24}$"))).select("doc_id")


@query("b20_keep_set", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 40)")
def b20(t: Tables) -> DataFrame:
    keep = t.documents.groupBy("source").agg(F.count("*").alias("n")).where("n >= 40").select("source")
    return t.documents.select("doc_id", "source").join(keep, "source", "left_semi").select("doc_id", "source")


@query("b22_reject_reason", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_discount > 0.08 THEN 'discount' WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 'flag' END AS reject_reason FROM lineitem")
def b22(t: Tables) -> DataFrame:
    rules = {"quantity": F.col("l_quantity") > 45, "discount": F.col("l_discount") > 0.08, "flag": ~F.col("l_returnflag").isin("A", "N", "R")}
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(*[F.when(bad, name) for name, bad in rules.items()]).alias("reject_reason"))


@query("b25_completeness", f"WITH p AS ({PAPERS}) SELECT id, (title IS NOT NULL)::INT + (journal IS NOT NULL)::INT + (year IS NOT NULL)::INT + (pages IS NOT NULL)::INT + (doi IS NOT NULL)::INT AS filled FROM p")
def b25(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", sum((F.col(c).isNotNull().cast("int") for c in ("journal", "year", "pages", "doi")), F.col("title").isNotNull().cast("int")).alias("filled"))


@query("b26_b27_b28_compound_bands", f"""WITH c AS ({COMPOUNDS}), v AS (SELECT *, coalesce((mw > 500)::INT, 0) + coalesce((logp > 5)::INT, 0) + (donors > 5)::INT + (acceptors > 10)::INT AS broken FROM c)
SELECT cid, CASE WHEN sweetness IS NULL THEN 'unknown' WHEN sweetness < 1 THEN 'below-sucrose' WHEN sweetness < 10 THEN 'low' WHEN sweetness <= 1000 THEN 'medium' ELSE 'high' END AS tier, broken, broken <= 1 AS passes, round(least(greatest((tpsa - 0) / 140.0, 0), 1) * 100, 6) AS radar FROM v""")
def b26(t: Tables) -> DataFrame:
    v = numbers.lipinski_violations(*[F.col(c) for c in ("mw", "logp", "donors", "acceptors")])
    return t.sql(COMPOUNDS).select("cid", numbers.sweetness_tier(F.col("sweetness")).alias("tier"), v.alias("broken"), (v <= 1).alias("passes"), F.round(numbers.scaled(F.col("tpsa"), 0, 140.0), 6).alias("radar"))


@query("b29_keep_old", f"WITH p AS ({PAPERS}) SELECT id, CASE WHEN lower(trim(coalesce(journal, ''), ' ')) IN {_MISSING} THEN 'kept' ELSE trim(journal, ' ') END AS journal FROM p")
def b29(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", F.coalesce(F.nullif(citations.present(F.col("journal")), F.lit("")), F.lit("kept")).alias("journal"))


@query("b30_id_lookup", "SELECT p_partkey FROM part WHERE substr(sha256(p_name), 1, 24) = (SELECT substr(sha256(min(p_name)), 1, 24) FROM part)")
def b30(t: Tables) -> DataFrame:
    wanted = t.part.agg(paths.document_id(F.min("p_name")).alias("wanted"))
    return t.part.join(F.broadcast(wanted), paths.document_id(F.col("p_name")) == F.col("wanted")).select("p_partkey")


@query("b31_decision_table", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'open' WHEN count(*) FILTER (o_orderstatus = 'O') = 0 THEN 'closed' WHEN count(*) > 12 THEN 'busy' ELSE 'mixed' END AS kind FROM orders GROUP BY o_custkey")
def b31(t: Tables) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.groupBy("o_custkey").agg(F.when(n("F") == 0, "open").when(n("O") == 0, "closed").when(F.count("*") > 12, "busy").otherwise("mixed").alias("kind"))


@query("b32_url_state", r"SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS INT) AS page, CASE WHEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) IN ('x', 'y') THEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) ELSE 'name' END AS sort FROM pages")
def b32(t: Tables) -> DataFrame:
    arg = lambda k: F.regexp_extract("url", rf"[?&]{k}=([^&#]*)", 1)
    return t.pages.select("page_id", arg("page").try_cast("int").alias("page"), F.when(arg("ref").isin("x", "y"), arg("ref")).otherwise("name").alias("sort"))


@query("j1_chunks", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, greatest(CAST(floor((len(ws) - 50 - 1) / 462.0) AS BIGINT), 0) + 1)) AS k FROM w WHERE len(ws) > 0)
SELECT doc_id, k AS chunk_index, sha256(array_to_string(ws[k * 462 + 1 : k * 462 + 512], ' ')) AS digest FROM s""")
def j1(t: Tables) -> DataFrame:
    c = t.documents.select("doc_id", F.posexplode(text.chunks(F.col("text"), 512, 50)).alias("chunk_index", "chunk"))
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.sha2("chunk", 256).alias("digest"))


_JOURNAL = "CASE " + " ".join(f"WHEN contains(lower(t), '{p}') THEN '{text.JOURNALS[p]}'" for p in sorted(text.JOURNALS, key=lambda p: -len(p))) + " END"


@query("h17_journal_names", f"WITH p AS (SELECT id, coalesce(journal, '') || ' ' || coalesce(title, '') AS t FROM ({PAPERS})) SELECT id, {_JOURNAL} AS journal FROM p")
def h17(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", text.journal_of(F.concat(F.coalesce("journal", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))).alias("journal"))


def _chain(c: str, table, test: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(c=c, p=p)} THEN '{n}'" for p, n in table.items())


@query("h17_journal_of_name", f"WITH p AS ({PAPERS}) SELECT id, {_chain('stem', text.JOURNALS, 'contains({c}, $${p}$$)')} ELSE 'Unknown Journal' END AS journal FROM (SELECT id, lower(regexp_replace(coalesce(journal, '') || '_' || filename, '\\.[^.]*$', '')) AS stem FROM p)")
def h17n(t: Tables) -> DataFrame:
    return t.sql(PAPERS).select("id", text.journal_of_name(F.concat(F.lit("/some/folder/"), F.coalesce("journal", F.lit("")), F.lit("_"), "filename")).alias("journal"))


_DOIS = "SELECT o_orderkey AS id, CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN '10.1016/j.FoodChem.2020.' || CAST(o_custkey AS STRING) WHEN 1 THEN '10.3390/foods1406' || CAST(o_custkey AS STRING) WHEN 2 THEN '10.3390/newJ' || CAST(o_custkey AS STRING) WHEN 3 THEN '10.1007/s00217-' || CAST(o_custkey AS STRING) WHEN 4 THEN '10.1038/S41598-' || CAST(o_custkey AS STRING) WHEN 5 THEN '10.1007/x' ELSE '10.3390/123' END AS doi FROM {orders}"


@query("h17_journal_of_doi", f"""WITH d AS (SELECT *, lower(doi) AS low, regexp_replace(split_part(doi, '/', 2), '[^A-Za-z]', '', 'g') AS code FROM ({_DOIS}))
SELECT id, {_chain('low', text.DOI_JOURNALS, "starts_with({c}, '{p}')")} WHEN starts_with(low, '10.3390') THEN {_chain('lower(code)', text.LETTER_JOURNALS, "{c} = '{p}'")} WHEN code <> '' THEN 'MDPI - ' || upper(code[1:1]) || lower(code[2:]) END
  WHEN starts_with(low, '10.1007') THEN {_chain('low', text.CODE_JOURNALS, "contains({c}, '{p}')")} END END AS journal FROM d""")
def h17d(t: Tables) -> DataFrame:
    return t.sql(_DOIS).select("id", text.journal_of_doi(F.col("doi")).alias("journal"))


_BODIES = "SELECT c_custkey AS id, c_name || chr(10) || CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'Smith J. A., Lee, K. and Doe P.' WHEN 1 THEN 'By Ann Lee' WHEN 2 THEN 'Moe, A. ' || chr(10) || 'Roe B. C.' ELSE 'Abe C.' || chr(10) || 'Bea D., Cal E., Dee F., Eve G., Fay H.' END AS body FROM {customer}"


@query("h18_authors_in_text", f"""WITH l AS (SELECT id, unnest(string_split(body, chr(10))[1:20]) AS l, generate_subscripts(string_split(body, chr(10))[1:20], 1) AS k FROM ({_BODIES})),
f AS (SELECT id, k, regexp_extract_all(l, '[A-Z][a-z]+(?:,?\\s+[A-Z]\\.)+') AS f, regexp_matches(l, '[A-Z][a-z]+\\s+[A-Z]\\.')::INT + regexp_matches(l, '[A-Z][a-z]+,\\s+[A-Z]\\.')::INT AS n FROM l)
SELECT id, array_to_string(flatten(list(CASE n WHEN 2 THEN list_concat(f, f) WHEN 1 THEN f ELSE [] END ORDER BY k))[1:5], '|') AS names FROM f GROUP BY id""")
def h18t(t: Tables) -> DataFrame:
    return t.sql(_BODIES).select("id", F.array_join(text.authors_in(F.col("body")), "|").alias("names"))


@query("h25_mentions", f"WITH r AS ({REQUESTS}) SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{k}' END" for k, p in text.MENTIONS.items()) + "], lambda x: x IS NOT NULL), ',') AS parameters FROM r")
def h25m(t: Tables) -> DataFrame:
    return t.sql(REQUESTS).select("id", F.array_join(text.mentioned(F.col("text")), ",").alias("parameters"))


@query("j21_numbered_citations", f"""WITH a AS ({ANSWERS}), c AS ({_CUT}), i AS (SELECT id, k, unnest({_IDS}) AS x, generate_subscripts({_IDS}, 1) AS j FROM c WHERE k <= len(groups)),
n AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY min(k * 1000 + j)) AS no FROM i GROUP BY id, x), l AS (SELECT id, k, string_agg('[[' || no || ']](#' || x || ')', ' ' ORDER BY j) AS links FROM i JOIN n USING (id, x) GROUP BY id, k)
SELECT id, string_agg(gap || coalesce(links, ''), '' ORDER BY k) AS answer FROM c LEFT JOIN l USING (id, k) GROUP BY id""")
def j21(t: Tables) -> DataFrame:
    return t.sql(ANSWERS).select("id", text.citations_numbered(F.col("answer")).alias("answer"))


@query("b24_approved_only", "SELECT quality, count(*) AS n FROM labels WHERE quality = 1 GROUP BY quality")
def b24(t: Tables) -> DataFrame:
    return t.labels.where("quality = 1").groupBy("quality").agg(F.count("*").alias("n"))


@query("h37_costs", "SELECT conv_id, turn, CAST(floor(length(text) / 3) AS BIGINT) AS tokens, round(floor(length(text) / 3) * 0.002 / 1000, 9) AS cost FROM conversations")
def h37(t: Tables) -> DataFrame:
    tokens = F.floor(F.length("text") / 3)
    return t.conversations.select("conv_id", "turn", tokens.alias("tokens"), F.round(tokens * 0.002 / 1000, 9).alias("cost"))


@query("h41_date_parts", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) END, CASE WHEN o_orderkey % 3 = 1 THEN year(o_orderdate) + 1 END, year(o_orderdate) + 2)::BIGINT AS year FROM orders")
def h41(t: Tables) -> DataFrame:
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 3
    body = F.to_json(F.struct(F.when(k == 0, F.array(F.array(y))).alias("print"), F.when(k == 1, F.array(F.array(y + 1))).alias("online"), F.array(F.array(y + 2)).alias("issued")))
    parts = F.from_json(body, "print array<array<bigint>>, online array<array<bigint>>, issued array<array<bigint>>")
    return t.orders.select("o_orderkey", F.coalesce(*[F.get(F.get(parts[c], 0), 0) for c in ("print", "online", "issued")]).alias("year"))


@query("j1_sentence_chunks")
def j1s(t: Tables) -> DataFrame:
    """Sentence chunks of every document, with their number and size."""
    made = t.documents.select("doc_id", F.posexplode(text.sentence_chunks(F.col("text"))).alias("no", "chunk"))
    return made.select("doc_id", "no", F.size(F.split("chunk", " ")).alias("words"), F.sha2("chunk", 256).alias("digest"))


@query("h1_text_tests", "SELECT p_partkey, lower(trim('  ' || p_brand || ' ')) AS brand, contains(lower(p_name), 'red') AS red, contains(p_type, '_') OR contains(p_type, '%') AS marks FROM part")
def h1(t: Tables) -> DataFrame:
    marks = F.contains("p_type", F.lit("_")) | F.contains("p_type", F.lit("%"))
    return t.part.select("p_partkey", F.lower(F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" ")))).alias("brand"), F.contains(F.lower("p_name"), F.lit("red")).alias("red"), marks.alias("marks"))


@query("f8_slices", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:5], '|') AS five, array_to_string(string_split(text, ' ')[1:10], '|') AS ten, array_to_string(string_split(text, ' ')[1:3], '|') AS three FROM documents")
def f8(t: Tables) -> DataFrame:
    words = F.split("text", " ")
    return t.documents.select("doc_id", *[F.array_join(F.slice(words, 1, n), "|").alias(k) for k, n in (("five", 5), ("ten", 10), ("three", 3))])


@query("g10_ordered_unique", "WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS l FROM part) SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS words FROM w")
def g10(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")), "|").alias("words"))
