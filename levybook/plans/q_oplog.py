"""Queries: operational-log analytics (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scan import Scan, running
from ..operators import oplog
from .fixtures import AS_OF_TS, SQL, derived
from .registry import query

c = F.col
null = lambda k: F.lit(None).cast(k)
NOW = f"TIMESTAMP '{AS_OF_TS}'"


@query("k1_refusing_hosts", "SELECT regexp_extract(url,'://([^/]*)',1) AS host, count(*) AS n, max(fetched_at) AS last_seen FROM page_log WHERE error IS NOT NULL OR http_status IN (401,403,429) GROUP BY 1 ORDER BY n DESC, host LIMIT 30")
def k1(t):
    return oplog.refusing_hosts(t.page_log)


for _n, _tab, _col in (("work_status", "work", "status"), ("batch_item_status", "batch_items", "status"), ("verdicts", "checks", "verdict"), ("fact_origin", "facts", "extraction_method")):
    query(f"k2_{_n}", f"SELECT {_col}, count(*) AS n FROM {_tab} GROUP BY 1")(lambda t, a=_tab, b=_col: oplog.histogram(getattr(t, a), b))


@query("k3_page_errors", "SELECT fetched_at, geoid, category, http_status, url, error FROM page_log WHERE error IS NOT NULL ORDER BY id DESC LIMIT 100")
def k3(t):
    return oplog.newest(t.page_log, c("error").isNotNull(), "id", 100, ["fetched_at", "geoid", "category", "http_status", "url", "error"])


@query("k3_empty_batch_items", "SELECT custom_id, geoid, category, status, error FROM batch_items WHERE status='failed' OR (status='done' AND error IS NOT NULL) ORDER BY custom_id DESC LIMIT 50")
def k3b(t):
    return oplog.newest(t.batch_items, (c("status") == "failed") | ((c("status") == "done") & c("error").isNotNull()), "custom_id", 50, ["custom_id", "geoid", "category", "status", "error"])


@query("k3_flagged_verdicts", "SELECT created_at, geoid, category, verdict, flags FROM checks WHERE verdict<>'pass' ORDER BY id DESC LIMIT 100")
def k3c(t):
    return oplog.newest(t.checks, c("verdict") != "pass", "id", 100, ["created_at", "geoid", "category", "verdict", "flags"])


@query("k3_intake_failures", "SELECT created_at, geoid, category, url, error FROM uploads WHERE status='failed' ORDER BY id DESC LIMIT 50")
def k3d(t):
    return oplog.newest(t.uploads, c("status") == "failed", "id", 50, ["created_at", "geoid", "category", "url", "error"])


@query("k3_pages_of_runs", "SELECT id, run_id, url FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS rn FROM page_log WHERE run_id IN (SELECT run_id FROM runs ORDER BY run_id DESC LIMIT 50)) x WHERE rn<=100")
def k3e(t):
    return oplog.newest_pages_of_runs(t.runs, t.page_log).select("id", "run_id", "url")


@query("k3_good_pages", "SELECT id, geoid, category FROM (SELECT *, row_number() OVER (PARTITION BY geoid, category ORDER BY id DESC) AS rn FROM page_log WHERE error IS NULL) x WHERE rn<=20")
def k3f(t):
    return oplog.newest_good_pages(t.page_log).select("id", "geoid", "category")


@query("k4_activity", """SELECT kind, ts, subject, detail FROM (
 SELECT * FROM (SELECT 'run_'||status AS kind, coalesce(finished_at, started_at) AS ts, CAST(run_id AS VARCHAR) AS subject, coalesce(message,'') AS detail FROM runs WHERE status IN ('failed','stopped') ORDER BY run_id DESC LIMIT 30) a
 UNION ALL SELECT * FROM (SELECT 'intake_failed', coalesce(finished_at, created_at), CAST(id AS VARCHAR), coalesce(error,'') FROM uploads WHERE status='failed' ORDER BY id DESC LIMIT 30) b
 UNION ALL SELECT * FROM (SELECT 'check_'||verdict, created_at, geoid||'/'||category, CASE WHEN flags LIKE '[{%' THEN 'use_tax: r'||CAST(id%5 AS VARCHAR)||'; ?: b' ELSE 'checker could not run' END FROM checks WHERE verdict IN ('flag','error') ORDER BY id DESC LIMIT 30) k) u
ORDER BY ts DESC, kind, subject LIMIT 30""")
def k4(t):
    return oplog.activity(t.runs, t.uploads, t.checks)


@derived("batches", """SELECT batch_id, n_items, created_at, CASE WHEN batch_id%4<>0 THEN created_at + INTERVAL 1 HOUR END AS submitted_at, CASE WHEN batch_id%3=0 THEN created_at + INTERVAL 2 HOUR END AS collected_at, CASE WHEN batch_id%5=0 THEN 'failed' ELSE 'ok' END AS status
 FROM (SELECT user_id AS batch_id, count(*) AS n_items, max(ts) - INTERVAL 3 HOUR AS created_at FROM events GROUP BY 1) x""")
def batches(t):
    b = t.events.groupBy(c("user_id").alias("batch_id")).agg(F.count("*").alias("n_items"), (F.max("ts") - F.expr("interval 3 hours")).alias("created_at"))
    i = c("batch_id")
    return b.select(i, "n_items", "created_at", F.when(i % 4 != 0, c("created_at") + F.expr("interval 1 hour")).alias("submitted_at"),
                    F.when(i % 3 == 0, c("created_at") + F.expr("interval 2 hours")).alias("collected_at"), F.when(i % 5 == 0, "failed").otherwise("ok").alias("status"))


EDGE = f"{NOW} - INTERVAL 48 HOUR"


@query("k5_timeline", f"""SELECT kind, ts, n FROM (
 SELECT CASE WHEN verdict='pass' THEN 'checks_passed' ELSE 'checks_flagged' END AS kind, max(created_at) AS ts, count(*) AS n FROM checks WHERE created_at >= {EDGE} GROUP BY 1
 UNION ALL SELECT 'run_'||status, coalesce(finished_at, started_at), pages_fetched FROM late_runs WHERE started_at >= {EDGE}
 UNION ALL SELECT kind, ts, n_items FROM (SELECT *, unnest(list_filter([CASE WHEN submitted_at IS NOT NULL THEN {{'kind':'batch_sent','ts':submitted_at}} END, CASE WHEN collected_at IS NOT NULL THEN {{'kind':'batch_back','ts':collected_at}} END,
   CASE WHEN status='failed' THEN {{'kind':'batch_failed','ts':coalesce(collected_at, submitted_at, created_at)}} END], lambda e: e IS NOT NULL), recursive := true) FROM batches WHERE coalesce(collected_at, submitted_at, created_at) >= {EDGE}) b) u
ORDER BY ts DESC NULLS LAST, kind LIMIT 8""")
def k5(t):
    return oplog.timeline(t.checks, t.late_runs, t.batches, AS_OF_TS)


@derived("late_runs", "SELECT run_id, started_at + INTERVAL 29 DAY AS started_at, status, CASE WHEN status='ok' THEN started_at + INTERVAL 698 HOUR END AS finished_at, pages_fetched FROM runs")
def late_runs(t):
    s = c("started_at")
    return t.runs.select("run_id", (s + F.expr("interval 29 days")).alias("started_at"), "status", F.when(c("status") == "ok", s + F.expr("interval 698 hours")).alias("finished_at"), "pages_fetched")


@query("k6_run_counters", """SELECT r.run_id, coalesce(p.n,0) AS pages_fetched, coalesce(f.n,0) AS findings_written, coalesce(f.g,0) AS items_claimed FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM page_log GROUP BY 1) p ON p.run_id=r.run_id
 LEFT JOIN (SELECT seq AS run_id, count(*) AS n, count(DISTINCT geoid) AS g FROM facts GROUP BY 1) f ON f.run_id=r.run_id""")
def k6(t):
    return oplog.run_counters(t.runs, t.page_log, t.facts.select(c("seq").alias("run_id"), "geoid"))


@derived("old_log", """SELECT geoid, category, query, CASE WHEN max(round_seq)%3=0 THEN 'ai' ELSE 'built_in' END AS source, CAST(5 AS BIGINT) AS tries, 'nothing' AS last_outcome, TIMESTAMP '2023-12-01 00:00:00' AS last_tried_at, '["old"]' AS results FROM search_round WHERE round_seq%4=0 GROUP BY 1,2,3""")
def old_log(t):
    r = t.search_round.where(c("round_seq") % 4 == 0).groupBy("geoid", "category", "query").agg(F.max("round_seq").alias("m"))
    return r.select("geoid", "category", "query", F.when(c("m") % 3 == 0, "ai").otherwise("built_in").alias("source"), F.lit(5).cast("bigint").alias("tries"), F.lit("nothing").alias("last_outcome"),
                    F.lit("2023-12-01 00:00:00").cast("timestamp_ntz").alias("last_tried_at"), F.lit('["old"]').alias("results"))


SQL["log"] = """SELECT coalesce(e.geoid, r.geoid) AS geoid, coalesce(e.category, r.category) AS category, coalesce(e.query, r.query) AS query, coalesce(e.source,'built_in') AS source, coalesce(e.tries,0)+coalesce(r.tries,0) AS tries,
 coalesce(r.last_outcome, e.last_outcome) AS last_outcome, coalesce(r.last_tried_at, e.last_tried_at) AS last_tried_at, coalesce(r.results, e.results) AS results
FROM old_log e FULL OUTER JOIN (SELECT geoid, category, query, count(*) AS tries, arg_max(outcome, round_seq) AS last_outcome, max(tried_at) AS last_tried_at, arg_max(results, round_seq) FILTER (WHERE results IS NOT NULL) AS results
  FROM search_round WHERE round_seq%2=1 GROUP BY 1,2,3) r ON r.geoid=e.geoid AND r.category=e.category AND r.query=e.query"""


@derived("search_log", SQL["log"])
def search_log(t):
    return oplog.search_log(t.old_log, t.search_round.where(c("round_seq") % 2 == 1))


@query("k7_search_log", "SELECT * FROM log")
def k7(t):
    return t.search_log


@derived("query_plan", "SELECT geoid, category, query, row_number() OVER (PARTITION BY geoid, category ORDER BY query) AS pos FROM (SELECT DISTINCT geoid, category, query FROM search_round) x")
def query_plan(t):
    q = t.search_round.select("geoid", "category", "query").distinct()
    return running(q, ["geoid", "category"], F.substring("query", 1, 2), ["query"], [Scan("pos", "sum", F.lit(1).cast("bigint"))])


FRESH = f"SELECT geoid, category, query, from_json(results,'[\"VARCHAR\"]') AS urls FROM log WHERE last_tried_at >= {NOW} - INTERVAL 7 DAY AND results IS NOT NULL"


@query("k8_reusable_results", f"""SELECT geoid, category, url, pos, url_pos FROM (SELECT *, row_number() OVER (PARTITION BY geoid, category, url ORDER BY pos, url_pos) AS rn FROM (
 SELECT p.geoid, p.category, p.pos, unnest(f.urls) AS url, CAST(unnest(range(len(f.urls))) AS INT) AS url_pos FROM query_plan p JOIN ({FRESH}) f ON f.geoid=p.geoid AND f.category=p.category AND f.query=p.query) x) y WHERE rn=1""")
def k8(t):
    return oplog.reusable_results(t.query_plan, t.search_log, AS_OF_TS)


@query("k8_queries_to_ask", f"SELECT p.* FROM query_plan p WHERE NOT EXISTS (SELECT 1 FROM ({FRESH.replace("7 DAY", "1 DAY")}) f WHERE f.geoid=p.geoid AND f.category=p.category AND f.query=p.query)")
def k8b(t):
    return oplog.queries_to_ask(t.query_plan, t.search_log, AS_OF_TS, days=1)


SQL["round_log"] = "SELECT geoid, category, query, source, CASE WHEN CAST(substr(query,2) AS BIGINT)%5=0 THEN 0 ELSE tries END AS tries, last_outcome, CAST(substr(query,2) AS BIGINT) AS log_id FROM log"


@query("k9_plan_round", """WITH candidates AS (SELECT geoid, category, query, 0 AS tier, log_id AS pos FROM round_log WHERE source='ai' AND tries=0
  UNION ALL SELECT geoid, category, query, 1, pos FROM query_plan p WHERE NOT EXISTS (SELECT 1 FROM round_log d WHERE d.last_outcome='nothing' AND d.geoid=p.geoid AND d.category=p.category AND d.query=p.query)
  UNION ALL SELECT geoid, category, query, 2, log_id FROM round_log WHERE source='ai' AND tries>0 AND last_outcome IN ('found','blocked'))
SELECT geoid, category, query, tier, row_number() OVER (PARTITION BY geoid, category ORDER BY tier, pos, query) AS rank FROM (
 SELECT geoid, category, query, min(tier) AS tier, arg_min(pos, tier) AS pos FROM (SELECT * FROM candidates
  UNION ALL SELECT geoid, category, query, 3, pos FROM query_plan p WHERE NOT EXISTS (SELECT 1 FROM candidates k WHERE k.geoid=p.geoid AND k.category=p.category)) u GROUP BY 1,2,3) x
QUALIFY rank<=8""")
def k9(t):
    return oplog.plan_round(t.query_plan, _round_log(t))


def _round_log(t):
    n = F.substring("query", 2, 20).cast("bigint")
    return t.search_log.withColumn("log_id", n).withColumn("tries", F.when(n % 5 == 0, 0).otherwise(c("tries")))


#: Excluded wordings: those whose number ends in 3, in every second state.
EXCLUDED = "(SELECT DISTINCT geoid, category, query FROM query_plan WHERE CAST(substr(query,2) AS BIGINT)%10=3 AND CAST(geoid AS BIGINT)%2=0)"


@query("k9_plan_round_excluding", f"""WITH dead AS (SELECT p.geoid, p.category, p.query, p.pos FROM query_plan p WHERE CAST(p.geoid AS BIGINT)%3<>0), live AS (SELECT geoid, category, query, 1 AS tier, pos FROM query_plan WHERE CAST(geoid AS BIGINT)%3=0),
left_over AS (SELECT * FROM live l WHERE NOT EXISTS (SELECT 1 FROM {EXCLUDED} x WHERE x.geoid=l.geoid AND x.category=l.category AND x.query=l.query)
 UNION ALL SELECT geoid, category, query, 3, pos FROM dead d WHERE NOT EXISTS (SELECT 1 FROM {EXCLUDED} x WHERE x.geoid=d.geoid AND x.category=d.category))
SELECT geoid, category, query, tier, row_number() OVER (PARTITION BY geoid, category ORDER BY tier, pos, query) AS rank FROM left_over QUALIFY rank<=8""")
def k9b(t):
    """Everything is dead but in every third state, so the last resort shows per item."""
    plan = t.query_plan
    log = plan.where(c("geoid").cast("bigint") % 3 != 0).select("geoid", "category", "query", F.lit("built_in").alias("source"), F.lit(1).alias("tries"), F.lit("nothing").alias("last_outcome"), c("pos").alias("log_id"))
    gone = plan.where((F.substring("query", 2, 20).cast("bigint") % 10 == 3) & (c("geoid").cast("bigint") % 2 == 0)).select("geoid", "category", "query")
    return oplog.plan_round(plan, log, gone)


@query("k10_needs_new_wording", """SELECT w.geoid, w.category, CAST(NOT x.held AS INT) AS nothing_on_file, CAST(coalesce(v.verdict IN ('flag','error'),FALSE) AS INT) AS last_check_failed FROM (
 SELECT w.geoid, w.category, CASE w.category WHEN 'elections' THEN EXISTS (SELECT 1 FROM measures m WHERE m.geoid=w.geoid AND m.superseded_by IS NULL) WHEN 'framework' THEN EXISTS (SELECT 1 FROM (SELECT state_usps FROM thresholds UNION ALL SELECT state_usps FROM grants) r WHERE r.state_usps=coalesce(j.state_usps, w.geoid))
  ELSE EXISTS (SELECT 1 FROM facts f WHERE f.geoid=w.geoid AND f.category=w.category AND f.superseded_by IS NULL) END AS held FROM work w LEFT JOIN jurisdiction j ON j.geoid=w.geoid) x
JOIN work w ON w.geoid=x.geoid AND w.category=x.category LEFT JOIN new_verdict v ON v.geoid=w.geoid AND v.category=w.category WHERE NOT x.held OR coalesce(v.verdict IN ('flag','error'),FALSE)""")
def k10(t):
    return oplog.needs_new_wording(t.work.select("geoid", "category"), t.facts, t.measures, t.thresholds, t.grants, t.jurisdiction, t.checks)


def _fmt(x):
    s = "'" + x.replace("'", "''") + "'"
    for k, v in (("{name}", "j.name"), ("{state}", "j.state_usps"), ("{kind}", "CASE j.kind WHEN 'county' THEN 'county' WHEN 'place' THEN 'city' WHEN 'mcd' THEN 'township' WHEN 'state' THEN 'state' WHEN 'school' THEN 'school district' ELSE 'government' END"),
                 ("{cat}", "replace(w.category,'_',' ')")):
        s = f"replace({s}, '{k}', {v})"
    return s


SETS = {k: "[" + ", ".join(_fmt(x) for x in v) + "]" for k, v in fixed.QUERY_TEMPLATES.items()}


@query("k11_search_wording", f"""SELECT geoid, category, CAST(unnest(range(len(q))) AS INT) AS pos, unnest(q) AS query FROM (SELECT w.geoid, w.category, CASE w.category WHEN 'framework' THEN {SETS['framework']} WHEN 'elections' THEN {SETS['elections']} ELSE {SETS['*']} END AS q
 FROM work w JOIN jurisdiction j ON j.geoid=w.geoid) x""")
def k11(t):
    items = t.work.join(t.jurisdiction.select("geoid", "name", c("state_usps").alias("state"), "kind"), "geoid").select("geoid", "category", "name", "state", "kind")
    return oplog.search_wording(items)


@query("k12_monthly_calls", "SELECT strftime(tried_at,'%Y-%m') AS month, CAST(sum(1+round_seq%3) AS BIGINT) AS calls, CASE WHEN sum(1+round_seq%3)>=1000 THEN 1 ELSE 0 END AS cap_reached FROM search_round GROUP BY 1")
def k12(t):
    return oplog.monthly_calls(t.search_round.select("tried_at", (1 + c("round_seq") % 3).alias("api_calls")), 1000)


PRICES = [("model-a", 5.0, 25.0), ("model-b", 3.0, 15.0), ("model-c", 1.0, 5.0)]
SQL["priced"] = """SELECT event_id, ts, model, (input_tokens*pin + (input_tokens//2)*pin*1.25::DOUBLE + (input_tokens//4)*pin*0.10::DOUBLE + output_tokens*pout)/1e6::DOUBLE / CASE WHEN is_batch=1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS usd
 FROM (SELECT *, CASE model WHEN 'model-a' THEN 5.0::DOUBLE WHEN 'model-b' THEN 3.0::DOUBLE WHEN 'model-c' THEN 1.0::DOUBLE ELSE 5.0::DOUBLE END AS pin, CASE model WHEN 'model-a' THEN 25.0::DOUBLE WHEN 'model-b' THEN 15.0::DOUBLE WHEN 'model-c' THEN 5.0::DOUBLE ELSE 25.0::DOUBLE END AS pout FROM model_usage) x"""


@derived("usage_priced", SQL["priced"])
def usage_priced(t):
    i = c("input_tokens")
    u = t.model_usage.withColumn("cache_write_tokens", F.floor(i / 2)).withColumn("cache_read_tokens", F.floor(i / 4))
    prices = F.broadcast(t.spark.createDataFrame(PRICES, "model string, usd_in double, usd_out double"))
    return oplog.price_usage(u, prices).select("event_id", "ts", "model", "usd")


@query("k13_price_usage", "SELECT event_id, model, round(usd,9) AS usd FROM priced")
def k13(t):
    return t.usage_priced.select("event_id", "model", F.round("usd", 9).alias("usd"))


@query("k14_spend_checkpoints", """WITH RECURSIVE days AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, sum(usd) AS usd, row_number() OVER (ORDER BY date_trunc('day', ts)) AS n FROM priced GROUP BY date_trunc('day', ts)),
fold AS (SELECT n, period, usd, usd AS total, CASE WHEN round(usd,6)>=0.9 THEN usd ELSE 0.0::DOUBLE END AS acked, CASE WHEN round(usd,6)>=0.9 THEN 1 ELSE 0 END AS stopped FROM days WHERE n=1
 UNION ALL SELECT d.n, d.period, d.usd, f.total+d.usd, CASE WHEN round(f.total+d.usd-f.acked,6)>=0.9 THEN f.total+d.usd ELSE f.acked END, CASE WHEN round(f.total+d.usd-f.acked,6)>=0.9 THEN 1 ELSE 0 END FROM fold f JOIN days d ON d.n=f.n+1)
SELECT period, round(usd,4) AS usd, round(total,4) AS total, stopped FROM fold""")
def k14(t):
    return oplog.spend_checkpoints(t.usage_priced, 0.9)


@query("k14_spend_without_checkpoint", """SELECT period, round(usd,4) AS usd, round(sum(usd) OVER (ORDER BY period),4) AS total, 0 AS stopped FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, sum(usd) AS usd FROM priced GROUP BY 1) x""")
def k14b(t):
    return oplog.spend_checkpoints(t.usage_priced, 0.0)
