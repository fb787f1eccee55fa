"""Queries of job logs, streams' event protocols, histories and parsed text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import ranges
from quern.plans.base import Tables, query
from quern.sources import tables
from quern.streaming import jobs

_STATUS = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'preparing' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'docking' END"
_LOG = f"SELECT event_id, user_id AS job, ts, {_STATUS} AS status FROM {{events}}"
_JOBS = f"l AS ({_LOG}), j AS (SELECT job, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at FROM l GROUP BY job)"
_SHOWN = "strftime(updated_at, '%Y-%m-%d %H:%M:%S')"


def current(t: Tables) -> DataFrame:
    return jobs.latest(t.sql(_LOG), "job", "ts", "status", tie="event_id")


def shown(df: DataFrame) -> DataFrame:
    return df.select("job", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("l3_latest_state", f"WITH {_JOBS} SELECT job, status, {_SHOWN} AS updated_at FROM j")
def l3(t: Tables) -> DataFrame:
    return shown(current(t))


@query("l4_expiry", f"WITH {_JOBS} SELECT job, CASE WHEN updated_at + INTERVAL 24 HOURS < TIMESTAMP '2024-01-31 12:00:00' AND status NOT IN ('preparing', 'docking', 'converting') THEN 'expired' ELSE status END AS status, {_SHOWN} AS updated_at FROM j")
def l4(t: Tables) -> DataFrame:
    return shown(jobs.expired(current(t), F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")))


@query("l5_recovery", f"WITH {_JOBS} SELECT job, CASE WHEN status IN ('preparing', 'docking', 'converting') THEN 'failed' ELSE status END AS status, {_SHOWN} AS updated_at FROM j")
def l5(t: Tables) -> DataFrame:
    return shown(jobs.recovered(current(t)))


@query("f9_next_queued", f"WITH {_JOBS} SELECT job, status, {_SHOWN} AS updated_at FROM j WHERE status = 'queued' ORDER BY j.updated_at, job LIMIT 3")
def f9(t: Tables) -> DataFrame:
    return shown(jobs.next_queued(current(t), 3))


@query("l6_heartbeat", "SELECT user_id AS worker, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECONDS AS online FROM events GROUP BY user_id")
def l6(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    beats = t.events.select(F.col("user_id").alias("worker"), "ts").join(F.broadcast(now))
    return beats.groupBy("worker").agg(F.max("ts").alias("last"), F.first("now").alias("now")).select("worker", (F.col("last") >= F.col("now") - F.expr("INTERVAL 3600 SECONDS")).alias("online"))


@query("l8_health_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS checks, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1")
def l8(t: Tables) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return t.events.groupBy(w.alias("w")).agg(F.count("*").alias("checks"), F.count_if(F.col("event_type") == "error").alias("failures")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "checks", "failures")


_PLACE = "list_position(['start', 'status', 'references', 'retrieval_stats', 'answer_start', 'answer', 'done'], kind)"
_STREAM = "SELECT user_id AS session, event_id AS no, CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'start' WHEN 1 THEN 'status' WHEN 2 THEN 'references' WHEN 3 THEN 'retrieval_stats' WHEN 4 THEN 'answer_start' WHEN 5 THEN 'answer' WHEN 6 THEN 'answer' WHEN 7 THEN 'done' ELSE 'error' END AS kind FROM {events}"


@query("l1_protocol", f"WITH s AS ({_STREAM}), r AS (SELECT *, coalesce({_PLACE}, 0) AS place, lag(coalesce({_PLACE}, 0)) OVER w AS before, lag(kind) OVER w AS last FROM s WINDOW w AS (PARTITION BY session ORDER BY no)) SELECT session, no, kind FROM r WHERE last IN ('done', 'error') OR (kind <> 'error' AND (place = 0 OR place < before))")
def l1(t: Tables) -> DataFrame:
    return jobs.protocol_breaks(t.sql(_STREAM), "session", "no", "kind")


@query("a20_sse_parse", "SELECT event_id, unnest([0, 1])::INT AS no, unnest(['message', event_type]) AS event, unnest(['{\"k\":' || user_id || '}', 'line one' || chr(10) || 'line two']) AS data FROM events")
def a20(t: Tables) -> DataFrame:
    body = F.concat(F.lit('data: {"k":'), F.col("user_id").cast("string"), F.lit("}\n\nevent: "), "event_type", F.lit("\ndata: line one\ndata: line two\n\n"))
    return jobs.sse_events(t.events.select("event_id", body.alias("body")), "event_id", "body")


@query("l10_history", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, role FROM conversations")
def l10(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.conversations.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint").alias("id"), "role")


@query("l11_stage_latency", "SELECT event_type AS stage, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS slowest FROM events GROUP BY 1")
def l11(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("stage"), "value")
    sums = rows.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("slowest"))
    return sums.join(ranges.quantiles(rows, ["stage"], "value", {"p95": 0.95}), "stage", "left").select("stage", "n", F.round("p95", 6).alias("p95"), "slowest")


@query("l_ext_sliding_windows", "WITH e AS (SELECT event_type, ts, unnest([0, 1]) AS k FROM events), w AS (SELECT event_type, time_bucket(INTERVAL 12 HOURS, ts) - k * INTERVAL 12 HOURS AS s FROM e) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM w GROUP BY ALL")
def sliding(t: Tables) -> DataFrame:
    return jobs.windowed(t.events, "ts", "24 hours", "event_type", slide="12 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def _folder(t: Tables, name: str) -> str:
    """A new folder in the shared one, for queries that write and read back."""
    return tables.folder(t.spark, name)


@query("a5_typed_csv_scan", "SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS id, o_totalprice AS price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority || ', \"q\"' END AS note FROM orders")
def a5(t: Tables) -> DataFrame:
    """Ids with leading zeros, commas and quotes, written as CSV and read by a schema."""
    from pyspark.sql import types as T

    from quern.sources import files

    at = _folder(t, "csv")
    note = F.when(F.col("o_orderkey") % 5 != 0, F.concat("o_orderpriority", F.lit(', "q"')))
    t.orders.select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("id"), F.col("o_totalprice").alias("price"), note.alias("note")).write.option("header", True).option("escape", '"').csv(at)
    return files.csv_table(t.spark, at, T.StructType.fromDDL("id string, price double, note string"))


@query("a6_parquet_scan_and_write", "SELECT l_orderkey::VARCHAR AS id, l_quantity FROM lineitem WHERE l_quantity >= 49")
def a6(t: Tables) -> DataFrame:
    at = _folder(t, "parquet")
    t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").cast("string").alias("id"), "l_quantity").write.parquet(at)
    return t.spark.read.parquet(at)


@query("a7_json_documents", "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_regionkey END AS region FROM nation")
def a7(t: Tables) -> DataFrame:
    """One document a region: an array, or an object that holds one."""
    from pyspark.sql import types as T

    from quern.sources import files

    at = _folder(t, "json")
    row = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 != 0, F.col("n_regionkey")).alias("region"))
    made = t.nation.groupBy("n_regionkey").agg(F.to_json(F.collect_list(row)).alias("items"))
    text = F.when(F.col("n_regionkey") % 2 == 0, F.col("items")).otherwise(F.concat(F.lit('{"rows": '), "items", F.lit("}")))
    made.select(text.alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(at)
    return files.json_list(t.spark, f"{at}/*", "rows", T.StructType.fromDDL("id bigint, name string, region bigint"))


@query("a13_a14_sheets", "SELECT 'nation' AS sheet, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def a13(t: Tables) -> DataFrame:
    from quern.sources import files

    at = _folder(t, "sheets")
    files.sheets({"nation": t.nation.select("n_name"), "region": t.region.select("r_name")}, at, "csv")
    read = lambda sheet, c: t.spark.read.option("header", True).csv(f"{at}/{sheet}").select(F.lit(sheet).alias("sheet"), F.col(c).alias("name"))
    return read("nation", "n_name").unionByName(read("region", "r_name"))


@query("a15_published_version", "SELECT r_regionkey AS id, r_name || '!' AS name FROM region")
def a15(t: Tables) -> DataFrame:
    """Two versions are published, a third breaks a check: readers stay with the second."""
    from quern.sources import files

    at, rows = _folder(t, "published"), t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    files.publish(rows, at, "1")
    files.publish(rows.withColumn("name", F.concat("name", F.lit("!"))), at, "2")
    try:
        files.publish(rows.limit(1), at, "3", [lambda df: df.where("id is not null")])
    except ValueError:
        return files.current(t.spark, at)
    raise AssertionError("a version that breaks a check was published")


@query("a18_backup_read", "SELECT r_regionkey, r_name FROM region")
def a18(t: Tables) -> DataFrame:
    """The first copy is no Parquet file, so the backup is read."""
    from quern.sources import files

    at = _folder(t, "damaged")
    t.region.select("r_name").coalesce(1).write.text(f"{at}/main")
    return files.with_fallback(t.spark.read.parquet, f"{at}/main", f"{t.dir}/region.parquet").select("r_regionkey", "r_name")


@query("a19_event_sink", "SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || coalesce(floor(value)::INT::VARCHAR, '') AS line FROM events")
def a19(t: Tables) -> DataFrame:
    """Events as lines of the protocol, written once for each micro-batch of a stream."""
    from quern.streaming import streams

    at = _folder(t, "sse")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/[e]vents.parquet")
    line = F.concat(F.lit("event: "), "event_type", F.lit("\n"), F.lit("data: "), F.coalesce(F.floor("value").cast("int").cast("string"), F.lit("")))
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    streams.to_sink(stream.select("event_id", line.alias("line")), f"{at}/checkpoint", write).awaitTermination()
    return t.spark.read.parquet(f"{at}/out").select("event_id", "line")


@query("a22_quarantine", "SELECT unnest(['quarantine', 'quarantine', 'rollback', 'purge']) AS action, unnest([true, false, true, true]) AS done, unnest([4, 1, 2, 2])::BIGINT AS n WHERE (SELECT count(*) FROM region) = 5")
def a22(t: Tables) -> DataFrame:
    """Four files set aside and a fifth that is missing; two come back, the other two are deleted."""
    from quern.sources import files

    at = _folder(t, "papers")
    t.region.where("r_regionkey < 4").select("r_name", F.col("r_regionkey").alias("k")).write.partitionBy("k").text(at)
    names = [r["path"] for r in files.listing(t.spark, at, [".txt"]).orderBy("path").collect()]
    made = t.spark.createDataFrame([(p, p.replace(at.rsplit("/", 1)[1], "held", 1) + f".{i}") for i, p in enumerate([*names, f"{at}/none.txt"])], "path string, held string")
    steps = [("quarantine", made), ("rollback", made.where("held like '%.0' or held like '%.1'")), ("purge", made.where("held like '%.2' or held like '%.3'"))]
    out = None
    for action, part in steps:
        one = files.apply_manifest(t.spark, part, action).select(F.lit(action).alias("action"), "done")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("action", "done").agg(F.count("*").alias("n"))


@query("n9_read_only", "SELECT r_name, 'upsert delete' AS rejected FROM region")
def n9(t: Tables) -> DataFrame:
    from quern.sources import files

    table, rejected = files.ReadOnly(t.region), []
    for action in ("upsert", "delete"):
        try:
            getattr(table, action)(t.region)
        except PermissionError:
            rejected.append(action)
    return table.df.select("r_name", F.lit(" ".join(rejected)).alias("rejected"))


@query("l7_domain_states", "SELECT unnest(['a', 'b', 'c', 'd']) AS domain, unnest(['ready', 'not_built', 'failed', 'not_loaded']) AS state, unnest([true, false, false, false]) AS ready, (SELECT count(*) FROM region) AS n")
def l7(t: Tables) -> DataFrame:
    """One domain that loads, one without an index, one whose loader raises, one that nobody asked for."""
    from quern.operators.runtime import Domains

    def broken() -> DataFrame:
        raise OSError("no such disk")

    domains = Domains({"a": lambda: t.region, "b": lambda: None, "c": broken, "d": lambda: t.nation})
    for name in "abc":
        try:
            domains.get(name)
        except (LookupError, OSError):
            continue
    return domains.snapshot(t.spark).select("domain", "state", "ready").crossJoin(domains.get("a").agg(F.count("*").alias("n")))


@query("h38_now", "SELECT r_regionkey, true AS iso FROM region")
def h38(t: Tables) -> DataFrame:
    """The current time in UTC as text, whose form is what can be checked."""
    now = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.region.select("r_regionkey", F.regexp_like(now, F.lit(r"^20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).alias("iso"))


@query("a8_json_entries", "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS value FROM events")
def a8(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("a8_huge_object", "SELECT 'v' || vec_id AS key, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def a8_huge(t: Tables) -> DataFrame:
    """All vectors in one JSON object of one file, read back by splits of it."""
    from quern.sources import json_objects

    at = _folder(t, "object")
    first = t.embeddings.agg(F.min("vec_id").alias("first"))  # its entry has no comma before it
    lines = t.embeddings.join(F.broadcast(first)).select((F.col("vec_id") - F.col("first") + 1).alias("o"), F.concat(F.when(F.col("vec_id") != F.col("first"), ",").otherwise(""), F.lit('"v'), "vec_id", F.lit('":'), F.to_json("embedding")).alias("value"))
    ends = t.spark.sql("""SELECT * FROM VALUES (0L, '{"note":"embedding_dict","embedding_dict":{'), (9223372036854775807L, '},"model":{"size":64}}') AS v(o, value)""")
    lines.unionByName(ends).repartition(1).sortWithinPartitions("o").select("value").write.text(at)  # one file has one writer
    value = F.from_json("value", "array<float>").cast("array<double>")
    found = json_objects.entries(t.spark, at, "embedding_dict").select("key", value.alias("v"))
    return found.select("key", F.size("v").cast("bigint").alias("n"), F.round(F.get("v", 0), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("a10_a11_matrix_files", "SELECT 'vec ' || lpad(vec_id::VARCHAR, 9, '0') AS id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def a10(t: Tables) -> DataFrame:
    """All vectors written as a matrix with its ids, and read back by offset."""
    from quern.sources import matrices

    at = _folder(t, "matrix") + "/vectors"
    matrices.write(t.embeddings.select(F.concat(F.lit("vec "), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("id"), "embedding"), at, "id", "embedding")
    found = matrices.with_ids(t.spark, at, 1 << 16)
    return found.select("id", F.size("values").cast("bigint").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.get("values", 0), 6).alias("first"))


@query("a4_a13_workbook", "SELECT 'parts' AS sheet, lpad(p_partkey::VARCHAR, 8, '0') AS id, p_name AS name, p_size::BIGINT AS size, round(p_retailprice, 2) AS price, p_size > 25 AS large FROM part UNION ALL SELECT 'suppliers', lpad(s_suppkey::VARCHAR, 8, '0'), s_name, NULL, round(s_acctbal, 2), NULL FROM supplier")
def a4(t: Tables) -> DataFrame:
    """Two tables as sheets of one workbook, read back by a schema: ids keep their zeros."""
    from quern.sources import workbooks

    at = _folder(t, "workbook") + "/both.xlsx"
    parts = t.part.select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("ID"), F.col("p_name").alias("name"), "p_size", F.round("p_retailprice", 2).alias("price"), (F.col("p_size") > 25).alias("large"))
    suppliers = t.supplier.select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("ID"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("price"))
    workbooks.write({"parts": parts, "suppliers": suppliers}, at)
    schema = "ID string, name string, p_size bigint, price double, large boolean"
    both = [workbooks.read(t.spark, at, schema, s).select(F.lit(s).alias("sheet"), F.col("ID").alias("id"), "name", F.col("p_size").alias("size"), "price", "large") for s in ("parts", "suppliers")]
    return both[0].unionByName(both[1])


@query("a9_ids_and_counts", "SELECT count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents")
def a9(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("a17_focus_list", "SELECT DISTINCT trim(l, ' ') AS line FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE trim(l, ' ') <> '' AND NOT starts_with(trim(l, ' '), '#')")
def a17(t: Tables) -> DataFrame:
    lines = t.conversations.select(F.explode(F.split("text", "\n")).alias("l")).select(F.trim("l").alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).distinct()


@query("a23_text_tables", "SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax AS y FROM lineitem")
def a23(t: Tables) -> DataFrame:
    line = F.concat(F.lit("  "), F.col("l_quantity").cast("string"), F.lit("   "), F.col("l_tax").cast("string"), F.lit(" "))
    parts = F.split(F.trim(line), r"\s+")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.get(parts, 0).try_cast("double").alias("x"), F.get(parts, 1).try_cast("double").alias("y"))


@query("a1_listing")
def a1(t: Tables) -> DataFrame:
    from quern.sources import files

    return files.listing(t.spark, t.dir, [".parquet"]).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length")


@query("a2_readability")
def a2(t: Tables) -> DataFrame:
    from quern.sources import files

    return files.checked(t.spark, t.dir).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "usable", "reason")


@query("l2_incremental_ingest", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def l2(t: Tables) -> DataFrame:
    """Two runs of the ingest job over the same folder; the second finds nothing new."""
    from quern.streaming import streams

    at = _folder(t, "ingest")
    source = f"{t.dir}/[e]vents.parquet"  # a pattern, as a stream wants a folder or a pattern
    schema = t.events.schema
    for _ in range(2):
        streams.ingest(t.spark, source, schema, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    out = t.spark.read.parquet(f"{at}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 3).alias("total"))


@query("n10_l9_resumable_build", "SELECT doc_id, lang FROM documents")
def l9(t: Tables) -> DataFrame:
    """A version is written, checked and published by a pointer swap; readers follow the pointer."""
    from quern.sources import files

    root = _folder(t, "release")
    files.guard(t.spark, root.rsplit("/", 1)[0], 0.001, 1000.0)
    files.publish(t.documents.select("doc_id", "lang"), root, "1", [lambda df: df.where("doc_id is null")])
    return files.current(t.spark, root)


@query("l9_stopped_build", "SELECT doc_id, length(coalesce(text, '')) AS n, (doc_id % 4)::INT AS batch, CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 2 END AS run FROM documents")
def l9_stopped(t: Tables) -> DataFrame:
    """A build of four batches that ends after two; the next run does the other two, and a third finds nothing to do."""
    from quern.streaming import builds

    root, rows = _folder(t, "build"), t.documents.select("doc_id", "text")
    measured = lambda df: df.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    for most in (2, None, None):
        builds.build(rows, root, F.col("doc_id") % 4, 4, measured, most)
    return builds.built(t.spark, root)


@query("l3_l4_queue_stream")
def l3_stream(t: Tables) -> DataFrame:
    """The events as requests to a job queue, read as a stream: each job's state after its legal moves and timers."""
    from quern.streaming import job_queue

    at = _folder(t, "queue")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/[e]vents.parquet")
    log = stream.select(F.col("user_id").alias("job"), "ts", F.expr(_STATUS).alias("status"))
    moves = job_queue.moved(log, "job", "ts", "status")
    moves.writeStream.format("parquet").option("path", f"{at}/moves").option("checkpointLocation", f"{at}/point").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return shown(job_queue.current(t.spark.read.parquet(f"{at}/moves")))
