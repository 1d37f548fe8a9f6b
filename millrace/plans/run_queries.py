"""Queries on runs, experiments, calls and events; relational smoke queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reporting
from ..session import shared_dir
from ..streaming import progress
from .catalogue import register, table
from .row_queries import _LAB, _ONE, _S, triples


@register("recent_runs", "SELECT run_id, epoch_us(started_at)::BIGINT AS started_us FROM pipeline_runs ORDER BY started_at DESC NULLS LAST, run_id LIMIT 10")
def recent_runs(spark, sf):
    return reporting.recent(table(spark, sf, "pipeline_runs"), "started_at", "run_id").select("run_id", F.unix_micros("started_at").alias("started_us"))


@register("live_runs", f"SELECT run_id FROM pipeline_runs WHERE NOT coalesce({_LAB('status')} IN ('completed', 'failed') AND epoch(TIMESTAMPTZ '2025-12-31 00:00:00+00') - epoch(started_at) > 3600, false)")
def live_runs(spark, sf):
    return reporting.live_runs(table(spark, sf, "pipeline_runs"), F.lit("2025-12-31 00:00:00").cast("timestamp")).select("run_id")


@register("run_status_counts", f"SELECT {_LAB('status')} AS status, count(*) AS n FROM pipeline_runs GROUP BY 1")
def run_status_counts(spark, sf):
    return reporting.histogram(table(spark, sf, "pipeline_runs"), "status")


@register("run_lookup", "SELECT run_id, quality_threshold FROM pipeline_runs WHERE run_id = (SELECT min(run_id) FROM pipeline_runs)")
def run_lookup(spark, sf):
    runs = table(spark, sf, "pipeline_runs")
    first = runs.agg(F.min("run_id").alias("run_id"))
    return runs.join(F.broadcast(first), "run_id", "left_semi").select("run_id", "quality_threshold")


@register("dashboard", f"WITH {_ONE} SELECT (SELECT count(*) FROM pipeline_runs) AS n_runs, count(*) AS n_triples, round(avg(nullif({_S}, 0)), 3) AS mean_quality FROM t")
def dashboard(spark, sf):
    return reporting.dashboard(table(spark, sf, "pipeline_runs"), triples(spark, sf))


@register(
    "late_rows",
    f"WITH {_ONE} SELECT t.run_id, count(*) AS n_late FROM t JOIN pipeline_runs r USING (run_id) WHERE t.created_at > r.completed_at GROUP BY t.run_id",
)
def late_rows(spark, sf):
    """Rows of a run delivered after its end: a join whose smaller side is the runs."""
    rows = table(spark, sf, "qa_triples").groupBy("triple_id").agg(F.max_by("run_id", "created_at").alias("run_id"), F.max("created_at").alias("created_at"))
    runs = table(spark, sf, "pipeline_runs").select("run_id", "completed_at")
    return rows.join(runs, "run_id").where("created_at > completed_at").groupBy("run_id").agg(F.count("*").alias("n_late"))


_EXP = f"""x AS (SELECT {_LAB('experiment_name')} AS experiment, t.quality_score, t.quality_score AS q, t.follow_up_a FROM t JOIN pipeline_runs USING (run_id)),
e AS (SELECT experiment, count(*) AS n_triples, round(avg({_S}), 6) AS avg_score, count_if(coalesce({_S}, 0) >= 0.7)::BIGINT AS accepted FROM x GROUP BY experiment)"""


def experiments(spark, sf):
    """Results by experiment, names trimmed and in lower case."""
    runs = table(spark, sf, "pipeline_runs").select("run_id", reporting.label_or_unknown(F.col("experiment_name")).alias("experiment"))
    s = F.when(~F.isnan("quality_score"), F.col("quality_score"))
    return triples(spark, sf).join(runs, "run_id").groupBy("experiment").agg(F.count("*").alias("n_triples"), F.round(F.avg(s), 6).alias("avg_score"), F.count_if(F.coalesce(s, F.lit(0.0)) >= 0.7).alias("accepted"))


@register("experiment_results", f"WITH {_ONE}, {_EXP} SELECT * FROM e")
def experiment_results(spark, sf):
    return experiments(spark, sf)


@register(
    "experiment_compare",
    f"""WITH {_ONE}, {_EXP}, a AS (SELECT * FROM e WHERE experiment = 'baseline'), b AS (SELECT * FROM e WHERE experiment = 'larger chunks')
    SELECT 'n_triples' AS field, round(b.n_triples - a.n_triples, 4)::DOUBLE AS delta FROM a, b UNION ALL SELECT 'avg_score', round(b.avg_score - a.avg_score, 4) FROM a, b UNION ALL SELECT 'accepted', round(b.accepted - a.accepted, 4)::DOUBLE FROM a, b""",
)
def experiment_compare(spark, sf):
    fields = reporting.by_field(experiments(spark, sf), "experiment", ["n_triples", "avg_score", "accepted"])
    return reporting.compare_experiments(fields, "experiment", "baseline", "larger chunks").select("field", "delta")


_CALLS = "calls AS (SELECT event_id, event_type AS agent, CASE WHEN event_id % 3 = 0 THEN 'small' WHEN event_id % 3 = 1 THEN 'large' ELSE 'other' END AS model, floor(value * 100)::BIGINT AS input_tokens, floor(value * 10)::BIGINT AS output_tokens FROM events)"
_PRICED = "priced AS (SELECT *, round(input_tokens / 1000 * CASE model WHEN 'small' THEN 0.5 WHEN 'large' THEN 2.0 ELSE 1.0 END + output_tokens / 1000 * CASE model WHEN 'small' THEN 1.0 WHEN 'large' THEN 4.0 ELSE 2.0 END, 6) AS cost FROM calls)"


@register("cost_rollup", f"WITH {_CALLS}, {_PRICED} SELECT agent, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cost::DECIMAL(24,6))::DOUBLE AS cost, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM priced GROUP BY ROLLUP (agent)")
def cost_rollup(spark, sf):
    """Events as a log of calls, priced from a table of (made-up) prices."""
    kind = F.element_at(F.array(F.lit("small"), F.lit("large"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    calls = table(spark, sf, "events").select("event_id", F.col("event_type").alias("agent"), kind.alias("model"), F.floor(F.col("value") * 100).alias("input_tokens"), F.floor(F.col("value") * 10).alias("output_tokens"))
    prices = spark.createDataFrame([("small", 0.5, 1.0), ("large", 2.0, 4.0), ("default", 1.0, 2.0)], "model string, in_price double, out_price double")
    return reporting.cost_rollup(reporting.call_costs(calls, prices))


@register(
    "progress_states",
    """SELECT user_id::VARCHAR AS run_id, count_if(event_type = 'view')::BIGINT AS phases_seen, max(CASE WHEN event_type IN ('purchase', 'error') THEN ts END) AS closed_at FROM events GROUP BY user_id""",
)
def progress_states(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.count_if(F.col("event_type") == "view").alias("phases_seen"), F.max(F.when(F.col("event_type").isin("purchase", "error"), F.col("ts"))).alias("closed_at"))


def _progress_of(events):
    kind = F.when(F.col("event_type") == "view", "phase_complete").when(F.col("event_type") == "purchase", "pipeline_complete").when(F.col("event_type") == "error", "pipeline_failed").otherwise("log")
    return events.select(F.col("user_id").cast("string").alias("run_id"), kind.alias("type"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 7 + 1).cast("int").alias("phase_number"), F.lit(7).alias("total_phases"))


def _as_progress(spark, sf):
    return _progress_of(table(spark, sf, "events"))


_RUN_STATES = """WITH e AS (SELECT user_id::VARCHAR AS run_id, CASE event_type WHEN 'view' THEN 'phase_complete' WHEN 'purchase' THEN 'pipeline_complete' WHEN 'error' THEN 'pipeline_failed' ELSE 'log' END AS type, ts, event_id % 7 + 1 AS p FROM events),
    s AS (SELECT run_id, max(CASE WHEN type LIKE 'pipeline_%' THEN {'ts': ts, 'type': type} END).type AS last, count_if(type = 'phase_complete') AS n_phase, coalesce(max(CASE WHEN type = 'phase_complete' THEN p END), 0)::INT AS phases_completed, count(*) AS n_events FROM e GROUP BY run_id)
    SELECT run_id, CASE last WHEN 'pipeline_complete' THEN 'completed' WHEN 'pipeline_failed' THEN 'failed' ELSE CASE WHEN n_phase > 0 THEN 'running' ELSE 'pending' END END AS status, phases_completed, floor(phases_completed / 7 * 100)::INT AS progress_pct, n_events FROM s"""


@register("run_states", _RUN_STATES)
def run_states(spark, sf):
    """The fold of run states as a batch; the stream of the same events gives the same table."""
    return progress.run_states(_as_progress(spark, sf))


@register(
    "event_windows",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def event_windows(spark, sf):
    out = progress.event_windows(table(spark, sf, "events"), "ts", "1 hour", "2 hours", "event_type")
    return out.withColumn("total", F.round("total", 4))


@register(
    "volume_by_supplier_nation",
    """SELECT n_name, year(l_shipdate::DATE)::INT AS ship_year, sum((l_extendedprice * (1 - l_discount))::DECIMAL(20,6))::DOUBLE AS revenue, count(*) AS n_lines
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
)
def volume_by_supplier_nation(spark, sf):
    """Volume check of joins and aggregation over the widest table."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_discount")
    named = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = lines.join(named, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("n_name", F.year(F.col("l_shipdate").cast("date")).alias("ship_year")).agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(20,6)")).cast("double").alias("revenue"), F.count("*").alias("n_lines"))


def _streamed(spark, sf, plan):
    """The result of a plan over the stream of events, once all of it has gone through."""
    # a pattern: a stream takes a folder or a pattern, and the table may be a single file
    source = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    name = f"stream_{uuid.uuid4().hex}"
    place = f"{shared_dir(spark)}/{name}"
    out = plan(source)
    # a complete result replaces the last one; it stays in the shared folder, not in the driver
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/result")
    out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/result")


@register("event_windows_streamed", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows_streamed(spark, sf):
    """The windows of ``event_windows`` from a stream with a watermark."""
    out = _streamed(spark, sf, lambda e: progress.event_windows(e, "ts", "1 hour", "2 hours", "event_type"))
    return out.withColumn("total", F.round("total", 4))


@register("run_states_streamed", _RUN_STATES)
def run_states_streamed(spark, sf):
    """The fold of ``run_states`` over the stream of the same events."""
    return _streamed(spark, sf, lambda e: progress.run_states(_progress_of(e)))


@register(
    "progress_lines",
    """WITH e AS (SELECT user_id::VARCHAR AS run_id, ts, CASE event_type WHEN 'view' THEN 'phase_complete' WHEN 'purchase' THEN 'pipeline_complete' WHEN 'error' THEN 'pipeline_failed' ELSE 'log' END AS type, event_id % 7 + 1 AS p FROM events)
    SELECT run_id, ts::TIMESTAMP AS ts, 'data: {"type":"' || type || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","run_id":"' || run_id || '","phase_number":' || p || ',"total_phases":7,"progress_pct":' || floor(p / 7 * 100)::INT || ',"level":"info"}' || chr(10) || chr(10) AS line FROM e""",
)
def progress_lines(spark, sf):
    """Events as lines of a server-sent stream."""
    e = _as_progress(spark, sf).withColumns({"phase": F.lit(None).cast("string"), "level": F.lit("info"), "message": F.lit(None).cast("string"), "details": F.lit(None).cast("string")})
    return progress.sse_lines(e)
