"""Registered queries of the training-text operators; each is a thin digest of its operator's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import alignment, arrays, chat, decontaminate, exact, fingerprints, language, lexical, licenses, mixing, neardup, pii, scratch, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: A conversation whose texts hold the template's own marks.
PROBE = r"""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS turn, role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(n, role)"""


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted, then digested from what reading the output back gives."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PROBE))
    out = chat.formatted(chat.reply_chain(rows)).withColumns({"turns": chat.read_back(F.col("formatted")), "cut": arrays.pieces(F.col("formatted"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumns({"said": said, "loss": chat.loss_text(F.col("cut"), F.col("loss_mask"))})
    return out.select(
        F.col("tree.conv_id").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
g AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<turn:') + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 1
        + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length('</turn>') + 1) AS n
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM g
"""


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5: fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and of its edited text; for ids divisible by 20, how many other documents lie within 3 and 8 bits, and their fingerprints, which doc_ids have in the same output."""
    found = scratch.written(fingerprints.edit_likeness(table(spark, sf_dir, "documents").select("doc_id", "text")), "op2")
    asked, prints = F.col("doc_id") % 20 == 0, found.select("doc_id", F.col("bits").alias("fingerprint"))
    near = fingerprints.within(prints.where(asked), prints)
    others = F.sort_array(F.collect_list(F.struct("distance", F.lower(F.lpad(F.hex("other"), 16, "0")).alias("fingerprint"), "copies"))).alias("neighbours")
    close = F.sum(F.when(F.col("distance") <= 3, F.col("copies"))) - 1
    near = near.groupBy(F.col("fingerprint").alias("bits")).agg(close.alias("n_within_3_bits"), (F.sum("copies") - 1).alias("n_within_8_bits"), others)
    joined = found.where(asked).join(near.hint("merge"), "bits", "left").select(*found.columns, "n_within_3_bits", "n_within_8_bits", "neighbours")
    return joined.unionByName(found.where(~F.coalesce(asked, F.lit(False))), allowMissingColumns=True).drop("bits")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other numbers, names or units, with each item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = scratch.written(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")), "op3")
    keyed = docs.select("doc_id", decontaminate.text_key(F.col("text")).alias("text_key"))
    return keyed.join(held, "text_key").select("doc_id", "item_id", F.col("covered").cast("bigint").alias("covered"), "share", F.col("altered").cast("bigint").alias("altered"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by prototypes bundled from the labelled rows outside fold 0."""
    docs = table(spark, sf_dir, "documents")
    prototypes = language.fit(docs.select("doc_id", "text", "lang"), fold_of(F.col("doc_id")) != 0)
    found = language.predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", (F.coalesce(fold_of(F.col("doc_id")), F.lit(0)) == 0).alias("held_out"), "lang_pred", "score")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document: base spans by rule, others by the classifier trained on the labelers' votes."""
    found = scratch.written(pii.labelled(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "candidates"), "op5")
    spans = pii.decided(found, pii.fit(found))
    base = F.filter("spans", lambda s: s["base"])

    def count(no: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == no)).cast("bigint").alias(f"n_{pii.KINDS[no]}")

    counts = [count(no) for no in range(len(pii.KINDS))]
    return spans.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by two-word shingles at a similarity of 0.8."""
    return neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2, percent=80)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a lexicon learned from the labels outside fold 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id")) != 0)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", (F.coalesce(fold_of(F.col("doc_id")), F.lit(0)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by the five host and path rules."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license wording found in a document, with its place, compression gain and differences."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode("licenses").alias("l"))
    return found.select("doc_id", "l.license", F.col("l.start").alias("start_char"), F.col("l.end").alias("end_char"), F.round("l.gain", 6).alias("gain"), "l.exact", F.array_join("l.differences", "; ").alias("differences"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources at weights 3, 1, 2 takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+')) AS raw FROM documents),
d AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf FROM words GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(regexp_replace(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM d GROUP BY term), total),
impacts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // l)) AS i FROM d JOIN sizes USING (doc_id), total WHERE term IN (SELECT term FROM asked)),
scores AS (SELECT item_id, doc_id, CAST(sum(w * i) AS BIGINT) AS score FROM asked JOIN impacts USING (term) JOIN weights USING (term) GROUP BY item_id, doc_id HAVING sum(w * i) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def op12_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts are equal without white space, and the row that stays of each."""
    return exact.duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies aligned by their end bytes in every document, with corpus-wide counts of the linked ids."""
    return alignment.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_fingerprints": op2_fingerprints,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_personal_data": op5_personal_data,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_url_filters": op8_url_filters,
    "op9_license_scan": op9_license_scan,
    "op10_source_mix": op10_source_mix,
    "op11_lexical_search": op11_lexical_search,
    "op12_exact_duplicates": op12_exact_duplicates,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {"op1_chat_formatting": OP1_SQL, "op11_lexical_search": OP11_SQL, "op12_exact_duplicates": OP12_SQL, "op8_url_filters": urls.oracle()}
