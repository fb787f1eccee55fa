"""A training corpus from ``documents`` in five stages; each returns rows that are written as Parquet and read as the next one's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), where docs has the columns of ``documents``
(doc_id, text, lang, source, n_chars) and perhaps others, which all stages but the last pass on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, mixing, neardup, pii, scratch, toxicity

#: SQL cannot express the learned, hashed and seeded stages; tests hold them against brute force on small tables.
ORACLE_SQL = None

SHINGLE_WORDS, SIMILARITY = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a lexicon learned from ``labels`` scores under 0.5. Null and empty texts score as texts without a hit; repeated rows go or stay together;
    an empty table, or one without labels, stays as it is."""
    lexicon = toxicity.fit(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"), F.lit(True))
    name = scratch.fresh(docs, "_toxicity")
    return toxicity.score(docs, lexicon, out_col=name).where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest id's, null ids last; of an id's several texts the one of the smallest digest.

    Rows are told apart by id and text, so an id that repeats with unlike texts keeps each of them. Rows equal in both stay once: the one with the
    least other columns, those that Spark can't order left out. Rows without a word stay, once for each id and text. An empty table gives no rows.
    """
    ordered = [f"`{f.name}`" for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    last, none = F.lit(2**63 - 1), F.lit(b"")
    named = [F.coalesce(F.col("doc_id").cast("bigint"), last).alias("_id"), F.coalesce(neardup.digest(F.col("text")), none).alias("_key")]
    row = F.struct(*[f"`{c}`" for c in docs.columns])
    one = docs.groupBy(*named).agg(F.min_by(row, F.struct(*ordered)).alias("_row"))
    kept = neardup.leaders(docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILARITY)
    kept = kept.select(F.coalesce("doc_id", last).alias("_id"), F.coalesce("text_key", none).alias("_key"))
    return scratch.shuffled(one, kept, ["_id", "_key"], "left_semi").select("_row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of ``benchmark``, neither word for word nor re-parameterised. Null and empty texts stay; repeated rows go or stay together;
    an empty table, or an empty benchmark, changes nothing."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in texts replaced by the kind in brackets; n_chars follows the new text.

    Spans are worked out once and written with their rows; the classifier is fitted on them and then decides on them. Null texts and their n_chars stay as
    they are; repeated rows are treated alike; an empty table gives no rows."""
    name = scratch.fresh(docs, "_candidates")
    found = scratch.written(pii.labelled(docs, out_col=name), "pipeline-pii")
    out = pii.redacted(found, pii.fit(found, name), col=name)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes words from, whole, with their size, their source's size and target, and how many words are taken.

    Null and empty texts have no words and so are in no mix; rows that repeat an id or a whole row are documents of their own; an empty table gives no rows."""
    return mixing.mixed(docs).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows. A stage's tables are deleted as soon as its result is written."""
    docs = _table(spark, sf_dir, "documents")
    since = scratch.mark()
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.release(since, keep=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
