"""Queries: the streaming jobs (N2-N6) over tables that arrive as a stream, against their batch twins.

Each table is written to the shared folder and read back as a stream that ends with
what is there; a last row far in the future closes what only the watermark closes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..streaming import jobs
from .registry import QUERIES, query

c = F.col


def _folder(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/streams/{name}-{uuid.uuid4().hex}"


def _arriving(t, df: DataFrame, name: str) -> DataFrame:
    path = _folder(t, name)
    df.write.parquet(path)
    return t.spark.readStream.schema(df.schema).parquet(path)


def _drained(t, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives until its input ends; a complete result is its last version."""
    out, schema = _folder(t, name + "-out"), stream.schema
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", _folder(t, name + "-state")).trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", out).start().awaitTermination()
    else:
        w.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return t.spark.read.schema(schema).parquet(out)


@query("n2_windowed_counts", """SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS start, verdict, count(*) AS n FROM check_result GROUP BY 1,2""")
def n2(t):
    log = t.check_result.select(c("created_at").cast("timestamp").alias("created_at"), "verdict")
    got = _drained(t, jobs.windowed_counts(_arriving(t, log, "n2"), "created_at", "verdict"), "n2", "complete")
    return got.select(c("start").cast("timestamp_ntz").alias("start"), "verdict", "n")


@query("n3_first_arrivals", "SELECT DISTINCT adapter, period_label, url, sha FROM archive_arrival")
def n3(t):
    a = t.archive_arrival.select(F.lit("2024-01-01").cast("timestamp").alias("ts"), "adapter", "period_label", "url", "sha")
    return _drained(t, jobs.first_arrivals(_arriving(t, a, "n3"), "ts"), "n3").select("adapter", "period_label", "url", "sha")


@query("n4_run_ends", """SELECT run_id, max(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(run_id AS INT)) + to_minutes(id%50)) AS finished_at, count(*) AS pages_fetched FROM page_log GROUP BY 1""")
def n4(t):
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=c("run_id").cast("int"), mins=(c("id") % 50).cast("int"))
    pages = t.page_log.select(at.alias("fetched_at"), "run_id")
    last = pages.groupBy().agg(F.max("fetched_at") + F.expr("interval 10 days")).toDF("fetched_at").withColumn("run_id", F.lit(-1).cast("bigint"))
    got = _drained(t, jobs.run_ends(_arriving(t, pages.unionByName(last), "n4")), "n4").where("run_id >= 0")
    return got.select("run_id", c("finished_at").cast("timestamp_ntz").alias("finished_at"), "pages_fetched")


@query("n5_spend_alerts", QUERIES["k14_spend_checkpoints"].sql)
def n5(t):
    u = t.usage_priced.select(c("ts").cast("timestamp").alias("ts"), "usd")
    last = u.groupBy().agg(F.max("ts") + F.expr("interval 10 days")).toDF("ts").withColumn("usd", F.lit(0.0))
    days = _drained(t, jobs.period_spend(_arriving(t, u.unionByName(last), "n5")), "n5-days")
    got = _drained(t, jobs.spend_alerts(_arriving(t, days, "n5-days"), 0.9), "n5")
    return got.select(c("period").cast("timestamp_ntz").alias("period"), F.round("usd", 4).alias("usd"), F.round("total", 4).alias("total"), "stopped")


@query("n6_newest_verdicts", "SELECT geoid, category, max(id) AS id, arg_max(verdict, id) AS verdict FROM checks GROUP BY 1,2")
def n6(t):
    out = _folder(t, "n6-out")
    jobs.newest_verdicts(_arriving(t, t.checks.select("id", "geoid", "category", "verdict"), "n6"), out, _folder(t, "n6-state")).awaitTermination()
    return jobs.read_newest(t.spark, out).select("geoid", "category", "id", "verdict")
