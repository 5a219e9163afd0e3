"""Queries: work-ledger transitions (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import ledger
from .fixtures import AS_OF_TS, SQL, derived
from .registry import query

c = F.col
null = lambda k: F.lit(None).cast(k)
NOW = f"TIMESTAMP '{AS_OF_TS}'"
PRI = """CAST(floor(CASE j.kind WHEN 'state' THEN 1000 WHEN 'county' THEN 100 WHEN 'place' THEN 10 WHEN 'mcd' THEN 5 WHEN 'school' THEN 20 ELSE 1 END * pow(log10(CAST(coalesce(j.population,0)+10 AS DOUBLE)),2)) AS BIGINT)"""
CATS = "(VALUES " + ",".join(f"('{x}')" for x in fixed.WORK_CATEGORIES) + ") AS k(category)"
SQL["bulk_keys"] = "SELECT DISTINCT geoid, category FROM facts WHERE superseded_by IS NULL AND extraction_method='bulk_import'"
NOBULK = "NOT EXISTS (SELECT 1 FROM bulk_keys b WHERE b.geoid=w.geoid AND b.category=w.category)"
BULK = "EXISTS (SELECT 1 FROM bulk_keys b WHERE b.geoid=w.geoid AND b.category=w.category)"


@query("i1_priority", f"SELECT geoid, {PRI} AS priority FROM jurisdiction j")
def i1(t):
    return t.jurisdiction.select("geoid", ledger.priority(c("kind"), c("population")).alias("priority"))


@query("i2_plan_items", f"""SELECT j.geoid, k.category, {PRI} AS priority, 'pending' AS status FROM jurisdiction j, {CATS} WHERE j.kind IN ('county','place','mcd','state')
 AND NOT (k.category='framework' AND j.kind<>'state') AND NOT (k.category='elections' AND j.kind<>'county') AND NOT EXISTS (SELECT 1 FROM work w WHERE w.geoid=j.geoid AND w.category=k.category)""")
def i2(t):
    return ledger.plan_items(t.jurisdiction, t.work, kinds=("county", "place", "mcd", "state"))


@query("i2_plan_filtered", f"""SELECT j.geoid, k.category, {PRI} AS priority, 'pending' AS status FROM (SELECT * FROM jurisdiction WHERE kind IN ('county','place') AND state_usps IN ('03','04') AND coalesce(population,0)>=1000 ORDER BY coalesce(population,0) DESC, geoid LIMIT 40) j,
 (VALUES ('income_payroll'),('other_levy')) AS k(category)""")
def i2b(t):
    return ledger.plan_items(t.jurisdiction, t.work, ["income_payroll", "other_levy"], limit=40, states=["03", "04"], min_pop=1000)


WCOLS = "w.geoid, w.category, w.status, w.attempts, w.priority"


@query("i3_claim", f"""SELECT w.geoid, w.category, 'in_progress' AS status, w.attempts+1 AS attempts, w.priority FROM work w JOIN jurisdiction j ON j.geoid=w.geoid WHERE w.status='pending' AND {NOBULK}
 AND w.attempts<4 AND j.kind IN ('county','place') ORDER BY w.priority DESC, w.geoid, w.category LIMIT 25""")
def i3(t):
    return ledger.claim(t.work, t.facts, t.jurisdiction, 25, max_attempts=4, kinds=["county", "place"]).select("geoid", "category", "status", "attempts", "priority")


@query("i4_file_bulk_covered", f"""SELECT w.geoid, w.category, CASE WHEN hit THEN 'complete' ELSE w.status END AS status, CASE WHEN hit THEN '{fixed.BULK_NOTE}' ELSE w.last_error END AS last_error,
 CASE WHEN hit THEN coalesce(w.completed_at, {NOW}) ELSE w.completed_at END AS completed_at FROM (SELECT w.*, {BULK} AND w.status IN ('pending','in_progress','needs_review') AS hit FROM work w) w""")
def i4(t):
    return ledger.file_bulk_covered(t.work, t.facts, AS_OF_TS).select("geoid", "category", "status", "last_error", "completed_at")


@query("i5_block_exhausted", """SELECT geoid, category, CASE WHEN status='pending' AND attempts>=4 THEN 'blocked' ELSE status END AS status,
 CASE WHEN status='pending' AND attempts>=4 THEN coalesce(last_error,'')||' | gave up after '||CAST(attempts AS VARCHAR)||' attempts; needs a source by hand' ELSE last_error END AS last_error FROM work""")
def i5(t):
    return ledger.block_exhausted(t.work, 4).select("geoid", "category", "status", "last_error")


@query("i6_release_stale", f"SELECT geoid, category, CASE WHEN status='in_progress' AND claimed_at < {NOW} - INTERVAL 24 HOUR THEN 'pending' ELSE status END AS status FROM work")
def i6(t):
    return ledger.release_stale(t.work, AS_OF_TS).select("geoid", "category", "status")


@query("i7_requeue_stale", f"""SELECT w.geoid, w.category, 'pending' AS status, CAST(0 AS BIGINT) AS attempts, 'refresh: last researched more than 365 days ago' AS last_error
 FROM work w WHERE w.status IN ('complete','no_data') AND w.completed_at < {NOW} - INTERVAL 365 DAY AND {NOBULK} ORDER BY w.priority DESC, w.geoid, w.category LIMIT 100""")
def i7(t):
    return ledger.requeue_stale(t.work, t.facts, AS_OF_TS, 365, 100).select("geoid", "category", "status", "attempts", "last_error")


@query("i8_unplanned", """SELECT j.geoid, j.kind, j.population, coalesce(p.n,0) AS planned FROM jurisdiction j LEFT JOIN (SELECT geoid, count(DISTINCT category) AS n FROM work WHERE category IN ('property','sales_use','elections') GROUP BY 1) p ON p.geoid=j.geoid
 WHERE j.kind IN ('county','place') AND coalesce(p.n,0)<3 ORDER BY coalesce(j.population,0) DESC, j.geoid LIMIT 250""")
def i8(t):
    return ledger.unplanned(t.jurisdiction, t.work, ["property", "sales_use", "elections"])


SQL["some_work"] = "SELECT * FROM work WHERE CAST(substr(geoid,1,2) AS INT)%2=0"


@query("i9_states_missing_pass", "SELECT DISTINCT j.state_usps FROM jurisdiction j WHERE j.kind='county' AND NOT EXISTS (SELECT 1 FROM some_work w WHERE w.geoid=j.geoid AND w.category='elections')")
def i9(t):
    return ledger.states_missing_pass(t.jurisdiction, t.work.where(F.substring("geoid", 1, 2).cast("int") % 2 == 0), "elections")


@derived("status_changes", """SELECT geoid, category, CASE attempts WHEN 0 THEN 'complete' WHEN 1 THEN 'no_data' WHEN 2 THEN 'pending' ELSE 'needs_review' END AS status, CASE WHEN attempts=2 THEN 'provider outage' END AS error, attempts=2 AS outage
 FROM work WHERE priority%3=0""")
def status_changes(t):
    a = c("attempts")
    return t.work.where(c("priority") % 3 == 0).select("geoid", "category", F.when(a == 0, "complete").when(a == 1, "no_data").when(a == 2, "pending").otherwise("needs_review").alias("status"),
                                                        F.when(a == 2, "provider outage").alias("error"), (a == 2).alias("outage"))


@query("i10_apply_status", f"""SELECT w.geoid, w.category, coalesce(k.status, w.status) AS status, CASE WHEN k.outage THEN greatest(w.attempts-1,0) ELSE w.attempts END AS attempts,
 CASE WHEN k.status IS NOT NULL THEN k.error ELSE w.last_error END AS last_error, CASE WHEN k.status IS NOT NULL THEN CASE WHEN k.status IN ('complete','no_data') THEN {NOW} END ELSE w.completed_at END AS completed_at
 FROM work w LEFT JOIN status_changes k ON k.geoid=w.geoid AND k.category=w.category""")
def i10(t):
    return ledger.apply_status(t.work, t.status_changes, AS_OF_TS).select("geoid", "category", "status", "attempts", "last_error", "completed_at")


@query("i11_state_needing_statutes", """SELECT j.state_usps FROM work w JOIN jurisdiction j ON j.geoid=w.geoid WHERE w.category='framework' AND w.status IN ('pending','in_progress') AND j.state_usps NOT IN ('02')
 AND NOT EXISTS (SELECT 1 FROM statute_section s WHERE s.citation='Sec. 1' AND s.state_usps=j.state_usps) ORDER BY coalesce(j.population,0) DESC, j.state_usps LIMIT 1""")
def i11(t):
    return ledger.state_needing_statutes(t.work, t.jurisdiction, t.statute_section.where(c("citation") == "Sec. 1"), ["02"])


@query("i12_review_queue", "SELECT w.geoid, w.category, j.name, j.state_usps, w.priority FROM work w JOIN jurisdiction j ON j.geoid=w.geoid WHERE w.status='needs_review' ORDER BY w.priority DESC, w.geoid, w.category LIMIT 40")
def i12(t):
    return ledger.review_queue(t.work, t.jurisdiction)


@query("i12_human_inbox", "SELECT w.geoid, w.category, w.status, w.last_error, w.priority, j.name, j.state_usps FROM work w JOIN jurisdiction j ON j.geoid=w.geoid WHERE w.status IN ('needs_review','blocked') OR coalesce(w.last_error,'')<>'' ORDER BY w.priority DESC, w.geoid, w.category LIMIT 40")
def i12b(t):
    return ledger.human_inbox(t.work, t.jurisdiction)


@query("i13_queue_listing", "SELECT w.geoid, w.category, w.status, w.priority, w.attempts, j.name, j.state_usps FROM work w JOIN jurisdiction j ON j.geoid=w.geoid WHERE j.state_usps='07' AND w.status='blocked' ORDER BY w.priority DESC, w.geoid, w.category LIMIT 200")
def i13(t):
    return ledger.queue_listing(t.work, t.jurisdiction, "07", "blocked")


@derived("batch_items", """SELECT 'c'||CAST(event_id AS VARCHAR) AS custom_id, user_id%20 AS batch_id, lpad(CAST(user_id%25+1 AS VARCHAR),2,'0') AS geoid, 'property' AS category,
 CASE event_id%4 WHEN 0 THEN 'queued' WHEN 1 THEN 'done' ELSE 'submitted' END AS status, CASE WHEN event_id%12=1 THEN 'nothing usable' END AS error, event_type FROM events WHERE event_id%9<>0""")
def batch_items(t):
    e, u = c("event_id"), c("user_id")
    return t.events.where(e % 9 != 0).select(F.concat(F.lit("c"), e.cast("string")).alias("custom_id"), (u % 20).alias("batch_id"), F.lpad((u % 25 + 1).cast("string"), 2, "0").alias("geoid"), F.lit("property").alias("category"),
                                             F.when(e % 4 == 0, "queued").when(e % 4 == 1, "done").otherwise("submitted").alias("status"), F.when(e % 12 == 1, "nothing usable").alias("error"), "event_type")


@derived("batch_results", """SELECT 'c'||CAST(event_id AS VARCHAR) AS custom_id, CASE WHEN event_type='error' THEN 'errored' ELSE 'succeeded' END AS result_type, CASE WHEN event_type='view' THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason, 't'||CAST(user_id AS VARCHAR) AS text
 FROM events WHERE event_id%4<>0 AND event_id%7<>0""")
def batch_results(t):
    e = c("event_id")
    return t.events.where((e % 4 != 0) & (e % 7 != 0)).select(F.concat(F.lit("c"), e.cast("string")).alias("custom_id"), F.when(c("event_type") == "error", "errored").otherwise("succeeded").alias("result_type"),
                                                              F.when(c("event_type") == "view", "max_tokens").otherwise("end_turn").alias("stop_reason"), F.concat(F.lit("t"), c("user_id").cast("string")).alias("text"))


@query("i14_reconcile_batch", """SELECT custom_id, geoid, category, change, CASE change WHEN 'landed' THEN 'ready' WHEN 'orphaned' THEN 'failed' ELSE status END AS status,
 CASE WHEN change='orphaned' THEN 'no result returned for this item' WHEN change='landed' AND rt='succeeded' AND sr='max_tokens' THEN 'batch result truncated at the output cap' WHEN change='landed' AND rt<>'succeeded' THEN 'batch result '||rt ELSE error END AS error,
 CASE WHEN change='landed' AND rt='succeeded' AND sr<>'max_tokens' THEN text END AS raw_response, CASE WHEN change='orphaned' THEN 'pending' END AS item_status
FROM (SELECT coalesce(i.custom_id, r.custom_id) AS custom_id, i.geoid, i.category, i.status, i.error, r.result_type AS rt, r.stop_reason AS sr, r.text,
 CASE WHEN i.custom_id IS NULL THEN 'unknown' WHEN i.status='submitted' AND r.custom_id IS NOT NULL THEN 'landed' WHEN i.status='submitted' THEN 'orphaned' WHEN r.custom_id IS NOT NULL THEN 'already_applied' ELSE 'untouched' END AS change
 FROM batch_items i FULL OUTER JOIN batch_results r ON r.custom_id=i.custom_id) x""")
def i14(t):
    return ledger.reconcile_batch(t.batch_items, t.batch_results)


@query("i15_batch_tallies", """SELECT batch_id, count(*) FILTER (WHERE o='done') AS done, count(*) FILTER (WHERE o='empty') AS empty, count(*) FILTER (WHERE o='failed') AS failed
 FROM (SELECT batch_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'empty' ELSE 'done' END AS o FROM batch_items) x GROUP BY 1""")
def i15(t):
    return ledger.batch_tallies(t.batch_items.withColumn("outcome", F.when(c("event_type") == "error", "failed").when(c("event_type") == "view", "empty").otherwise("done")))


@query("i16_return_parked", "SELECT custom_id, CASE WHEN status='queued' THEN 'failed' ELSE status END AS status, CASE WHEN status='queued' THEN 'batch mode turned off before submission' ELSE error END AS error FROM batch_items")
def i16(t):
    return ledger.return_parked(t.batch_items)[0].select("custom_id", "status", "error")


@query("i17_close_orphans", """SELECT r.run_id, r.started_at, CASE WHEN r.status='running' THEN 'failed' ELSE r.status END AS status, CASE WHEN r.status='running' THEN coalesce(p.last, r.started_at) ELSE r.finished_at END AS finished_at
 FROM runs r LEFT JOIN (SELECT run_id, max(fetched_at) AS last FROM page_log WHERE run_id%8<>0 GROUP BY 1) p ON p.run_id=r.run_id""")
def i17(t):
    return ledger.close_orphans(t.runs, t.page_log.where(c("run_id") % 8 != 0))
