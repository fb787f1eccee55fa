"""URL filters: host-suffix and path-prefix expressions joined with a rule table on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule table of at most this many rows is broadcast; a larger one is joined by shuffle with salted keys.
BROADCAST_RULES = 200_000
#: Copies of each rule that a salted join deals out, so that one host's pages spread over as many tasks.
SALTS = 32
PREFIX_HEX = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most_labels: int) -> Column:
    """``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``; only suffixes with at most ``most_labels`` labels."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most_labels))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def path_prefixes(path: Column, most_chars: int, odd_lengths: list[int]) -> Column:
    """Prefixes that end at a slash, and those of ``odd_lengths``; none longer than ``most_chars``."""
    short = F.left(path, F.lit(most_chars))
    pieces = F.split(short, "/", -1)
    ends = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 1),
        lambda k: F.length(F.array_join(F.slice(pieces, 1, k), "/")) + 1,
    )
    ends = F.when(F.size(pieces) > 1, ends).otherwise(F.array().cast("array<int>"))
    odd = F.array(*[F.lit(n) for n in odd_lengths]).cast("array<int>")
    lengths = F.filter(F.array_distinct(F.concat(ends, odd)), lambda n: n <= F.length(short))
    return F.transform(lengths, lambda n: F.left(short, n))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per distinct (host, path) of ``rules(host, path, verdict)``: block wins over allow, null fields never fit."""
    expr = F.concat("rule_host", "rule_path")
    digest = F.sha2(F.concat_ws("\x00", "rule_host", "rule_path"), 256)
    return (
        rules.where("host is not null and path is not null and host <> '' and verdict in ('allow', 'block')")
        .select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # block sorts after allow
        .select("rule_host", "rule_path", "rule_verdict", expr.alias("rule"), digest.alias("rule_digest"), F.left(digest, F.lit(PREFIX_HEX)).alias("short"))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Verdict on every row of ``pages(page_id, url)`` by ``rules(host, path, verdict)``.

    A rule fits its host and all subdomains when the url's path starts with the rule's path; the longest rule
    (characters of host and path, then of the host) wins. Returns ``page_id, host, path, rule, verdict``, one row
    for each input row. No fitting rule: ``rule`` null, verdict ``default``. Null or malformed urls have an empty
    host and path and so no rule. Repeated rows are judged once and repeated again; an empty page or rule table is
    fine; other columns, whatever their names, are ignored.

    Pages are reduced to distinct (page_id, url) with map-side counts, so a url that fills a third of the table
    costs one row. Rules of a checked number are broadcast; beyond it the join is shuffled on (hash prefix, salt).
    """
    rules = prepared_rules(rules)
    shape = rules.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"),
        F.max(F.length("rule_path")).alias("chars"),
        F.collect_set(F.when(~F.col("rule_path").endswith("/"), F.length("rule_path"))).alias("odd"),
    ).first()
    labels, chars, odd = shape["labels"] or 1, shape["chars"] or 0, sorted(shape["odd"] or [])

    distinct = pages.groupBy("page_id", "url").agg(F.count("*").alias("copies")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    pairs = F.flatten(
        F.transform(
            host_suffixes(F.col("host"), labels),
            lambda h: F.transform(path_prefixes(F.col("path"), chars, odd), lambda p: F.struct(h.alias("h"), p.alias("p"))),
        )
    )
    expressions = distinct.withColumn("e", F.explode_outer(pairs))
    digest = F.sha2(F.concat_ws("\x00", "e.h", "e.p"), 256)
    expressions = expressions.withColumns({"digest": digest, "short": F.left(digest, F.lit(PREFIX_HEX))})
    if shape["n"] <= broadcast_rules:
        matched = expressions.join(F.broadcast(rules), ["short"], "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        dealt = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = expressions.withColumn("salt", salt).join(dealt, ["short", "salt"], "left")
    sure = (F.col("digest") == F.col("rule_digest")) & (F.col("e.h") == F.col("rule_host")) & (F.col("e.p") == F.col("rule_path"))
    rank = F.struct(F.length("rule"), F.length("rule_host"))
    best = matched.groupBy("page_id", "url").agg(
        F.first("copies").alias("copies"),
        F.first("host").alias("host"),
        F.first("path").alias("path"),
        F.max_by(F.struct("rule", "rule_verdict"), F.when(sure, rank)).alias("best"),
    )
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_copy"),
    ).drop("_copy")


#: Rules of the registered query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark, rules=RULES) -> DataFrame:
    values = ", ".join(f"(r'{h}', r'{p}', '{v}')" for h, p, v in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")


def oracle(rules=RULES, default: str = "allow") -> str:
    """DuckDB SQL that tries every rule on every page."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH rules(rh, rp, rv) AS (VALUES {values}),
p AS (SELECT row_number() OVER () AS rid, page_id, url,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.rid, r.*, row_number() OVER (PARTITION BY p.rid ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS k
      FROM p JOIN rules r ON (p.host = rh OR suffix(p.host, '.' || rh)) AND prefix(p.path, rp))
SELECT page_id, host, path, rh || rp AS rule, coalesce(rv, '{default}') AS verdict
FROM p LEFT JOIN m ON p.rid = m.rid AND m.k = 1"""
