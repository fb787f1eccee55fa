"""Evidence ranking, topic boundary, supplementation and context packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import numbers, text
from quern.operators.ranges import ranked

# Journals and cues of evidence, with their scores.
TOP_JOURNALS = ["nature", "science", "cell", "lancet", "new england journal of medicine", "jama", "british medical journal", "bmj", "food chemistry",
    "journal of agricultural and food chemistry", "trends in food science", "comprehensive reviews in food science"]
SECOND_JOURNALS = ["nutrition", "metabolism", "diabetes", "obesity", "clinical", "american journal", "european journal", "food hydrocolloids", "food research international",
    "journal of food science", "lwt", "meat science"]
STUDY_TYPES = {"meta-analysis": 5.0, "systematic review": 5.0, "randomized controlled trial": 4.5, "rct": 4.5, "cohort": 3.5, "case-control": 3.0,
    "cross-sectional": 2.5, "animal study": 2.0, "in vivo": 2.0, "in vitro": 1.5, "review": 1.5}
EXPERIMENT_CUES = ["results show", "we found", "significantly", "p<0.05", "p < 0.05", "p-value", "anova", "t-test", "实验表明", "结果显示", "显著",
    "measured", "determined", "observed", "demonstrated"]
REVIEW_CUES = ["review", "reported that", "according to", "综述", "已有研究表明", "previous studies", "it has been shown", "literature"]
WEIGHTS = {"semantic": 0.35, "study": 0.20, "evidence": 0.20, "journal": 0.10, "recency": 0.10}
LEVELS = {"strong": 3.2, "moderate": 2.2}


def study_score(title: Column, content: Column) -> Column:
    """Best score of the study types named in the title or the first 800 characters; 2 at least."""
    t = F.lower(F.concat_ws(" ", title, F.left(content, F.lit(800))))
    return F.greatest(F.lit(2.0), *[F.when(t.contains(k), F.lit(v)) for k, v in STUDY_TYPES.items()])


def evidence_of(content: Column) -> tuple[Column, Column]:
    """Type and score by the cues in the first 1500 characters."""
    t = F.left(content, F.lit(1500))
    shown, told = text.count_contained(t, EXPERIMENT_CUES), text.count_contained(t, REVIEW_CUES)
    kind = F.when(shown >= 2, "experimental").when(told >= 2, "review_citation").when(shown == 1, "experimental").otherwise("indirect")
    score = F.when(shown >= 2, 4.5).when(told >= 2, 2.5).when(shown == 1, 3.5).otherwise(2.0)
    return F.coalesce(kind, F.lit("indirect")), F.coalesce(score, F.lit(2.0))


def journal_score(journal: Column) -> Column:
    return F.when(F.coalesce(text.contains_any(journal, TOP_JOURNALS), F.lit(False)), 5.0).when(F.coalesce(text.contains_any(journal, SECOND_JOURNALS), F.lit(False)), 3.5).otherwise(2.0)


def evidence_ranked(refs: DataFrame, as_of: int) -> DataFrame:
    """Adds sub-scores, total, level and final score to ``refs(title, content, journal, year, score)``; rounded to 2 and 6 digits."""
    kind, evidence = evidence_of(F.col("content"))
    parts = {
        "semantic": F.least(F.lit(5.0), F.coalesce("score", F.lit(0.0)) * 10),
        "study": study_score(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))),
        "evidence": evidence,
        "journal": journal_score(F.coalesce("journal", F.lit(""))),
        "recency": numbers.recency(text.year_of(F.coalesce("year", F.lit(""))), as_of),
    }
    out = refs.withColumns({f"{k}_score": c for k, c in parts.items()} | {"evidence_type": kind})
    total = sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("total_score", F.round(total, 6))
    level = F.when(F.col("total_score") >= LEVELS["strong"], "strong").when(F.col("total_score") >= LEVELS["moderate"], "moderate").otherwise("weak")
    return out.withColumns({"evidence_level": level, "final_score": F.round(F.coalesce("score", F.lit(0.0)) * 0.6 + F.round("total_score", 2) / 5.0 * 0.4, 6)})


def overlap_of(c: Column, terms: Sequence[str], concepts: dict[str, Sequence[str]]) -> tuple[Column, Column]:
    """Terms that the text contains, and concepts one of whose aliases it contains."""
    hits = sum((text.contains_any(c, a).cast("int") for a in concepts.values() if a), F.lit(0))
    return (text.count_contained(c, terms) if terms else F.lit(0)), hits


def topic_score(base: Column, overlap: Column, concept_hits: Column, focus: Column | None = None) -> Column:
    """Focus papers first, then concept hits, then overlap, then the score."""
    return (F.when(focus, 2000).otherwise(0) if focus is not None else F.lit(0)) + concept_hits * 1000 + overlap * 10 + base


def numbered(refs: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """``ref_id`` ref_1, ref_2, ... in the given (total) order, for each group of ``by``, whatever a group's size."""
    placed = ranked(refs, list(by), list(order), "_no")
    return placed.withColumn("ref_id", F.concat(F.lit("ref_"), F.col("_no").cast("string"))).drop("_no", "all__no")


def supplemented(refs: DataFrame, catalog: DataFrame, target: int, overlap: Column, concept_hits: Column, allow_weak: bool = True) -> DataFrame:
    """``refs(file_path, title)`` filled up to ``target`` rows from ``catalog(file_path, title, year)``, strong candidates first.

    Candidates share neither path nor lower-cased title with a reference: two anti joins. A bounded sort picks the rows needed.
    """
    needed = max(0, target - refs.limit(target).count())
    found = catalog.join(refs.select("file_path").distinct(), "file_path", "left_anti")
    taken = refs.select(F.lower(F.coalesce("title", F.lit(""))).alias("_t")).distinct()
    found = found.join(taken, F.lower(F.coalesce(F.col("title"), F.lit(""))) == F.col("_t"), "left_anti")
    found = found.withColumns({"overlap": overlap, "concept_hits": concept_hits, "year_int": F.coalesce(text.year_of(F.col("year")), F.lit(0))})
    strong = (F.col("overlap") > 0) | (F.col("concept_hits") > 0)
    if not allow_weak:
        found = found.where(strong)
    order = [F.desc(strong), F.desc(F.when(strong, F.col("concept_hits"))), F.desc(F.when(strong, F.col("overlap"))), F.desc("year_int"), F.asc("file_path")]
    picked = found.orderBy(*order).limit(needed) if needed else found.where(F.lit(False))
    extra = picked.select("file_path", "title", (F.lit(0.04) + F.lit(0.01) * F.col("overlap")).alias("score"), F.lit(True).alias("supplemented"))
    return refs.select("file_path", "title", F.col("score"), F.lit(False).alias("supplemented")).unionByName(extra)


def packed(chunks: DataFrame, key: str, budget: int) -> DataFrame:
    """Chunks of ``chunks(key, ref_no, chunk_no, n)`` that a reader with ``budget`` characters takes, for each ``key``.

    References come in order, and a reference stops at its first chunk that does not fit, though later, shorter ones of other references may
    still fit. An ordered fold over the sizes of one answer's chunks.
    """
    kind = "struct<ref_no:int,chunk_no:int,n:int>"
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("ref_no", "chunk_no", "n")]))).alias("rows"))
    start = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("stopped"), F.array().cast(f"array<{kind}>").alias("taken"))

    def step(s: Column, r: Column) -> Column:
        shut = (s["stopped"] == r["ref_no"]) | (s["total"] >= budget)
        fits = ~shut & (s["total"] + r["n"] <= budget)
        return F.struct(
            F.when(fits, s["total"] + r["n"]).otherwise(s["total"]).alias("total"),
            F.when(~shut & ~fits, r["ref_no"]).otherwise(s["stopped"]).alias("stopped"),
            F.when(fits, F.array_append(s["taken"], r)).otherwise(s["taken"]).alias("taken"),
        )

    folded = rows.select(key, F.aggregate("rows", start, step)["taken"].alias("taken"))
    return folded.select(key, F.explode("taken").alias("r")).select(key, "r.ref_no", "r.chunk_no", "r.n")


def references(papers: DataFrame, catalog: DataFrame, dataset_name: str = "dataset") -> DataFrame:
    """``papers(file_path, filename, score)`` with what ``catalog(file_path, title, journal, year, doi)`` knows of them.

    Known papers get defaults for absent fields; unknown ones are named by their file, and files or folders named like datasets are marked so.
    """
    known = catalog.select(F.col("file_path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in ("title", "journal", "year", "doi")])
    j = papers.join(known, F.col("file_path") == F.col("_path"), "left")
    has = F.col("_path").isNotNull()
    named = F.lower("file_path").contains(dataset_name + "s") | F.lower("filename").contains(dataset_name)
    return j.select(
        "file_path", "filename", "score",
        F.when(has, F.coalesce("_title", F.lit("Unknown Title"))).otherwise(F.col("filename")).alias("title"),
        F.when(has, F.coalesce("_journal", F.lit("Unknown Journal"))).when(named, "dataset").otherwise("Unknown").alias("journal"),
        F.when(has, F.coalesce("_year", F.lit("N/A"))).otherwise("N/A").alias("year"),
        F.when(has, F.coalesce("_doi", F.lit("Not Available"))).otherwise("Not Available").alias("doi"),
    )
