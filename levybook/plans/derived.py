"""Views the operators are fed with: fixture tables completed to full ledger rows.

Each has the Spark builder and, for the oracle, the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, ledger, merge
from .fixtures import AS_OF, derived

c = F.col
NTZ = "timestamp_ntz"


def _case(col, mapping, other=None):
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(other)


def n_documents(t):
    """How many documents there are, as a scalar subquery."""
    return t.documents.agg(F.count(F.lit(1))).scalar()


@derived("places", """
SELECT *, substr(geoid,1,2) AS state_fips, CASE WHEN kind='county' THEN geoid
  WHEN kind='place' AND TRY_CAST(substr(geoid,3) AS BIGINT)%3=0
  THEN substr(geoid,1,2)||lpad(CAST(TRY_CAST(substr(geoid,3) AS BIGINT)%97 AS VARCHAR),5,'0') END AS county_fips
FROM jurisdiction""")
def places(t):
    n = F.substring("geoid", 3, 10).try_cast("bigint")
    st = F.substring("geoid", 1, 2)
    return t.jurisdiction.withColumn("state_fips", st).withColumn(
        "county_fips", F.when(c("kind") == "county", c("geoid")).when(
            (c("kind") == "place") & (n % 3 == 0), F.concat(st, F.lpad((n % 97).cast("string"), 5, "0"))))


@derived("facts", """
SELECT geoid||'/'||instrument_code||'/'||CAST(seq AS VARCHAR) AS id, geoid, category, instrument_code, seq, status,
  rate_value, rate_unit, cap_value, cap_unit, effective_date, expiration_date, extraction_method, confidence,
  source_quote, retrieved_at, source_id, CAST(NULL AS BIGINT) AS fiscal_year,
  CASE WHEN seq%13=0 THEN 'per-diem allowance' ELSE instrument_code END AS label,
  geoid||'/'||instrument_code||'/'||CAST(superseded_by_seq AS VARCHAR) AS superseded_by,
  (source_id*7919+seq*31)%(SELECT count(*) FROM documents) AS archive_file_id FROM tax_instrument
UNION ALL SELECT geoid||'/county_general_sales/1', geoid, 'sales_use', 'county_general_sales', 1, 'levied',
  CASE WHEN geoid='07' THEN 30.0::DOUBLE ELSE CAST(2+CAST(geoid AS BIGINT)%5 AS DOUBLE) END, 'percent', NULL, 'percent', '1996-01-01', NULL, 'manual', 'high',
  'see the state code', CASE WHEN CAST(geoid AS BIGINT)%2=1 THEN '1996-06-01' ELSE '1998-01-01' END, CASE WHEN CAST(geoid AS BIGINT)%4=0 THEN -1 ELSE CAST(geoid AS BIGINT)-1 END, NULL, 'state sales tax', NULL, CAST(geoid AS BIGINT)
FROM jurisdiction WHERE kind='state'""")
def facts(t):
    s = c("seq")
    ident = F.concat_ws("/", "geoid", "instrument_code", s.cast("string"))
    base = t.tax_instrument.select(
        ident.alias("id"), "geoid", "category", "instrument_code", "seq", "status", "rate_value", "rate_unit", "cap_value",
        "cap_unit", "effective_date", "expiration_date", "extraction_method", "confidence", "source_quote", "retrieved_at",
        "source_id", F.lit(None).cast("bigint").alias("fiscal_year"),
        F.when(s % 13 == 0, "per-diem allowance").otherwise(c("instrument_code")).alias("label"),
        F.when(c("superseded_by_seq").isNotNull(), F.concat_ws("/", "geoid", "instrument_code", c("superseded_by_seq").cast("string"))).alias("superseded_by"),
        ((c("source_id") * 7919 + s * 31) % n_documents(t)).alias("archive_file_id"))
    g = c("geoid").cast("bigint")
    null = lambda k: F.lit(None).cast(k)
    st = t.jurisdiction.where(c("kind") == "state").select(
        F.concat(c("geoid"), F.lit("/county_general_sales/1")).alias("id"), "geoid", F.lit("sales_use").alias("category"),
        F.lit("county_general_sales").alias("instrument_code"), F.lit(1).cast("bigint").alias("seq"), F.lit("levied").alias("status"),
        F.when(c("geoid") == "07", F.lit(30.0)).otherwise((2 + g % 5).cast("double")).alias("rate_value"), F.lit("percent").alias("rate_unit"), null("double").alias("cap_value"),
        F.lit("percent").alias("cap_unit"), F.lit("1996-01-01").alias("effective_date"), null("string").alias("expiration_date"),
        F.lit("manual").alias("extraction_method"), F.lit("high").alias("confidence"), F.lit("see the state code").alias("source_quote"),
        F.when(g % 2 == 1, "1996-06-01").otherwise("1998-01-01").alias("retrieved_at"), F.when(g % 4 == 0, F.lit(-1)).otherwise(g - 1).alias("source_id"), null("bigint").alias("fiscal_year"),
        F.lit("state sales tax").alias("label"), null("string").alias("superseded_by"), g.alias("archive_file_id"))
    return base.unionByName(st)


@derived("grants", """
SELECT id, CASE WHEN state_usps='21' THEN '20' ELSE state_usps END AS state_usps, jurisdiction_kind, category, instrument_code, permitted,
  CASE WHEN id%19=0 THEN NULL ELSE max_rate END AS max_rate, CASE WHEN id%17=0 THEN NULL ELSE 'percent' END AS max_rate_unit,
  CASE WHEN id%13=0 THEN ' ' ELSE 'Code 5.'||CAST(id AS VARCHAR) END AS statute_cite,
  CASE WHEN id%4=0 THEN 'stacks with state' END AS stacking_rule, effective_from, effective_to,
  CASE WHEN id%5=0 THEN 'low' ELSE 'high' END AS confidence, CAST(id%4+1 AS INT) AS authority_tier
FROM authority_grant""")
def grants(t):
    i = c("id")
    return t.authority_grant.select(
        "id", F.when(c("state_usps") == "21", "20").otherwise(c("state_usps")).alias("state_usps"), "jurisdiction_kind", "category", "instrument_code", "permitted",
        F.when(i % 19 != 0, c("max_rate")).alias("max_rate"), F.when(i % 17 != 0, "percent").alias("max_rate_unit"),
        F.when(i % 13 == 0, " ").otherwise(F.concat(F.lit("Code 5."), i.cast("string"))).alias("statute_cite"),
        F.when(i % 4 == 0, "stacks with state").alias("stacking_rule"), "effective_from", "effective_to",
        F.when(i % 5 == 0, "low").otherwise("high").alias("confidence"), (i % 4 + 1).cast("int").alias("authority_tier"))


@derived("thresholds", """
SELECT id, CASE WHEN state_usps='21' THEN '20' ELSE state_usps END AS state_usps, jurisdiction_kind, measure_class, CASE WHEN id%6=1 THEN 'county_general_sales' END AS instrument_code,
  CASE id%5 WHEN 0 THEN 'general' WHEN 1 THEN 'either' END AS purpose_restriction,
  CASE WHEN id%23=0 THEN CAST(0.6667 AS DOUBLE) ELSE threshold_value END AS threshold_value,
  CASE WHEN id%7=0 THEN 'registered_voters' ELSE 'votes_cast' END AS threshold_basis,
  CASE WHEN id%11=0 THEN NULL ELSE 'Code 9.'||CAST(id AS VARCHAR) END AS statute_cite, effective_from, effective_to,
  CASE WHEN id%5=0 THEN 'low' ELSE 'high' END AS confidence, CAST(id%4+1 AS INT) AS authority_tier
FROM threshold_rule""")
def thresholds(t):
    i = c("id")
    return t.threshold_rule.select(
        "id", F.when(c("state_usps") == "21", "20").otherwise(c("state_usps")).alias("state_usps"), "jurisdiction_kind", "measure_class", F.when(i % 6 == 1, "county_general_sales").alias("instrument_code"),
        _case(i % 5, {0: "general", 1: "either"}).alias("purpose_restriction"),
        F.when(i % 23 == 0, F.lit(0.6667)).otherwise(c("threshold_value")).alias("threshold_value"),
        F.when(i % 7 == 0, "registered_voters").otherwise("votes_cast").alias("threshold_basis"),
        F.when(i % 11 != 0, F.concat(F.lit("Code 9."), i.cast("string"))).alias("statute_cite"), "effective_from", "effective_to",
        F.when(i % 5 == 0, "low").otherwise("high").alias("confidence"), (i % 4 + 1).cast("int").alias("authority_tier"))


@derived("measure_rows", """
SELECT CAST(substr(measure_id_local,7) AS BIGINT) AS id, geoid, election_date, measure_id_local, measure_class, outcome,
  CASE CAST(substr(measure_id_local,7) AS BIGINT)%4 WHEN 0 THEN 'county_general_sales' WHEN 1 THEN 'use_tax' END AS instrument_code,
  CASE CAST(substr(measure_id_local,7) AS BIGINT)%3 WHEN 0 THEN 'general' WHEN 1 THEN 'special' END AS purpose_type,
  CASE WHEN CAST(substr(measure_id_local,7) AS BIGINT)%43=0 THEN NULL ELSE votes_yes END AS votes_yes,
  CASE WHEN CAST(substr(measure_id_local,7) AS BIGINT)%31=0 THEN votes_total-votes_yes END AS votes_no,
  CASE WHEN CAST(substr(measure_id_local,7) AS BIGINT)%31=0 THEN NULL ELSE votes_total END AS votes_total,
  CASE WHEN CAST(substr(measure_id_local,7) AS BIGINT)%37=0 THEN CAST(55 AS DOUBLE) END AS pct_yes,
  votes_total*3 AS registered_voters, votes_total+7 AS ballots_cast, CAST(NULL AS DOUBLE) AS turnout_pct,
  CASE WHEN CAST(substr(measure_id_local,7) AS BIGINT)%29=0 THEN CAST(58 AS DOUBLE) END AS threshold_required,
  CAST(NULL AS VARCHAR) AS threshold_basis, CASE WHEN CAST(substr(measure_id_local,7) AS BIGINT)%53=0 THEN CAST(-3 AS DOUBLE) END AS margin_vs_threshold,
  CASE WHEN CAST(substr(measure_id_local,7) AS BIGINT)%41=0 THEN CAST(substr(measure_id_local,7) AS BIGINT)+1 END AS superseded_by,
  CASE WHEN CAST(substr(measure_id_local,7) AS BIGINT)%5=0 THEN 'low' ELSE 'high' END AS confidence,
  CAST(CAST(substr(measure_id_local,7) AS BIGINT)%4+1 AS INT) AS authority_tier
FROM ballot_measure""")
def measure_rows(t):
    i = c("id")
    m = t.ballot_measure.withColumn("id", F.substring("measure_id_local", 7, 30).cast("bigint"))
    null = lambda k: F.lit(None).cast(k)
    return m.select(
        "id", "geoid", "election_date", "measure_id_local", "measure_class", "outcome",
        _case(i % 4, {0: "county_general_sales", 1: "use_tax"}).alias("instrument_code"),
        _case(i % 3, {0: "general", 1: "special"}).alias("purpose_type"),
        F.when(i % 43 != 0, c("votes_yes")).alias("votes_yes"),
        F.when(i % 31 == 0, c("votes_total") - c("votes_yes")).alias("votes_no"), F.when(i % 31 != 0, c("votes_total")).alias("votes_total"),
        F.when(i % 37 == 0, F.lit(55.0)).alias("pct_yes"), (c("votes_total") * 3).alias("registered_voters"),
        (c("votes_total") + 7).alias("ballots_cast"), null("double").alias("turnout_pct"),
        F.when(i % 29 == 0, F.lit(58.0)).alias("threshold_required"), null("string").alias("threshold_basis"),
        F.when(i % 53 == 0, F.lit(-3.0)).alias("margin_vs_threshold"), F.when(i % 41 == 0, i + 1).alias("superseded_by"),
        F.when(i % 5 == 0, "low").otherwise("high").alias("confidence"), (i % 4 + 1).cast("int").alias("authority_tier"))


@derived("measure_rule", """
SELECT id, rule_id, rule_value, rule_basis FROM (
  SELECT m.id, r.id AS rule_id, r.threshold_value AS rule_value, r.threshold_basis AS rule_basis,
    row_number() OVER (PARTITION BY m.id ORDER BY CASE WHEN r.jurisdiction_kind IS NULL THEN 1 ELSE 0 END,
      CASE WHEN r.instrument_code IS NULL THEN 1 ELSE 0 END,
      CASE WHEN r.purpose_restriction = m.purpose_type THEN 0 WHEN r.purpose_restriction='either' THEN 1 ELSE 2 END,
      coalesce(r.effective_from,'0000') DESC, r.id DESC) AS rn
  FROM measure_rows m JOIN jurisdiction j ON j.geoid=m.geoid
  JOIN thresholds r ON r.state_usps=j.state_usps AND r.measure_class=m.measure_class
   AND (r.jurisdiction_kind IS NULL OR r.jurisdiction_kind=j.kind)
   AND (r.instrument_code IS NULL OR r.instrument_code=m.instrument_code)
   AND (r.purpose_restriction IS NULL OR r.purpose_restriction='either' OR r.purpose_restriction=m.purpose_type)
   AND (r.effective_from IS NULL OR r.effective_from<=m.election_date)
   AND (r.effective_to IS NULL OR r.effective_to>=m.election_date)) x WHERE rn=1""")
def measure_rule(t):
    r = merge.resolve_thresholds(t.measure_rows, t.jurisdiction, t.thresholds)
    return r.where(c("rule_id").isNotNull()).select("id", "rule_id", "rule_value", "rule_basis")


@derived("measures", """
SELECT id, geoid, election_date, measure_id_local, measure_class, outcome, instrument_code, purpose_type, votes_yes, votes_no,
  votes_total, pct_yes, registered_voters, ballots_cast, turnout_pct, threshold_required, threshold_basis, threshold_rule_id,
  coalesce(margin_vs_threshold, CASE WHEN threshold_basis IS NULL OR threshold_basis IN ('votes_cast','votes_cast_plus_turnout_validation')
    THEN round(pct_yes-threshold_required,4) END) AS margin_vs_threshold, superseded_by, confidence, authority_tier
FROM (SELECT * REPLACE (coalesce(pct_yes, CASE WHEN votes_total>0 THEN round(100.0::DOUBLE*votes_yes/votes_total,4) END) AS pct_yes,
    coalesce(turnout_pct, CASE WHEN registered_voters>0 THEN round(100.0::DOUBLE*ballots_cast/registered_voters,4) END) AS turnout_pct)
  FROM (SELECT m.* REPLACE (coalesce(votes_total, votes_yes+votes_no) AS votes_total,
      coalesce(threshold_required, rule_value) AS threshold_required,
      CASE WHEN threshold_required IS NULL THEN coalesce(threshold_basis, rule_basis) ELSE threshold_basis END AS threshold_basis),
      CASE WHEN threshold_required IS NULL THEN rule_id END AS threshold_rule_id
    FROM measure_rows m LEFT JOIN measure_rule r ON r.id=m.id) a) b""")
def measures(t):
    return merge.derive_measures(t.measure_rows, t.jurisdiction, t.thresholds)


@derived("rate_rows", """
SELECT geoid, category, instrument_code, seq AS line_no, CAST(rate_pct AS DOUBLE)/100.0::DOUBLE AS rate_intra,
  CASE WHEN seq%11=0 THEN (rate_pct+1)/100.0::DOUBLE ELSE rate_pct/100.0::DOUBLE END AS rate_inter,
  CASE WHEN seq%7=0 THEN CAST(0 AS DOUBLE) ELSE rate_pct/100.0::DOUBLE END AS rate_food,
  effective_date AS begin_date, CASE WHEN seq%5=0 THEN '9999-12-31' WHEN seq%3=0 THEN '1997-12-31' ELSE '1999-12-31' END AS end_date,
  seq%5=0 AS open_ended, CASE WHEN CAST(substr(geoid,1,2) AS INT)%3=0 THEN 2024 ELSE 2026 END AS period_year
FROM rate_history""")
def rate_rows(t):
    s, r = c("seq"), c("rate_pct")
    return t.rate_history.select(
        "geoid", "category", "instrument_code", s.alias("line_no"), (r / 100.0).alias("rate_intra"),
        F.when(s % 11 == 0, (r + 1) / 100.0).otherwise(r / 100.0).alias("rate_inter"),
        F.when(s % 7 == 0, F.lit(0.0)).otherwise(r / 100.0).alias("rate_food"), c("effective_date").alias("begin_date"),
        F.when(s % 5 == 0, "9999-12-31").when(s % 3 == 0, "1997-12-31").otherwise("1999-12-31").alias("end_date"),
        (s % 5 == 0).alias("open_ended"),
        F.when(F.substring("geoid", 1, 2).cast("int") % 3 == 0, 2024).otherwise(2026).alias("period_year"))


EVENTS_SQL = """
SELECT geoid, category, instrument_code, change_type, rate_before, rate_after, effective_period, arrival FROM (
  SELECT geoid, category, instrument_code, before AS rate_before, rate AS rate_after, begin_date AS effective_period, line_no AS arrival,
    CASE WHEN rn=1 THEN 'new' WHEN before IS DISTINCT FROM rate THEN CASE WHEN coalesce(rate,0)>coalesce(before,0) THEN 'increase' ELSE 'decrease' END
      WHEN open_ended AND NOT was_open THEN 'extended' END AS change_type
  FROM (SELECT *, lag(rate) OVER w AS before, lag(open_ended) OVER w AS was_open, row_number() OVER w AS rn
    FROM (SELECT *, round(CASE WHEN rate_intra>1 THEN rate_intra ELSE rate_intra*100.0::DOUBLE END,4) AS rate FROM rate_rows) a
    WINDOW w AS (PARTITION BY geoid, instrument_code ORDER BY begin_date, line_no)) b) c WHERE change_type IS NOT NULL"""
EXPIRED_SQL = """
SELECT geoid, category, instrument_code, 'expired' AS change_type, rate AS rate_before, CAST(NULL AS DOUBLE) AS rate_after,
  end_date AS effective_period, line_no AS arrival FROM (
  SELECT *, round(CASE WHEN rate_intra>1 THEN rate_intra ELSE rate_intra*100.0::DOUBLE END,4) AS rate,
    row_number() OVER (PARTITION BY geoid, instrument_code ORDER BY begin_date DESC, line_no DESC) AS rn FROM rate_rows) a
WHERE rn=1 AND NOT open_ended AND end_date<'%s'""" % AS_OF


@derived("rate_events", EVENTS_SQL)
def rate_events(t):
    return changes.rate_events(t.rate_rows)


@derived("rate_expired", EXPIRED_SQL)
def rate_expired(t):
    return changes.expired_events(t.rate_rows, AS_OF)


@derived("rate_change", """
SELECT geoid, category, instrument_code, change_type, rate_before, rate_after, effective_period,
  CASE WHEN change_type='increase' AND substr(effective_period,6,2)='01' THEN TRY_CAST(substr(geoid,3) AS BIGINT)
       WHEN change_type='decrease' AND substr(effective_period,6,2)='02' THEN CAST(-1 AS BIGINT) END AS measure_id
FROM (SELECT *, row_number() OVER (PARTITION BY geoid, category, instrument_code, change_type, effective_period ORDER BY arrival) AS rn
  FROM (SELECT * FROM rate_events UNION ALL SELECT * FROM rate_expired) u) x WHERE rn=1""")
def rate_change(t):
    ev = t.rate_events.unionByName(t.rate_expired)
    none = t.spark.createDataFrame([], "geoid string, category string, instrument_code string, change_type string, effective_period string")
    month = F.substring("effective_period", 6, 2)
    return changes.store_events(none, ev).drop("rate_unit").withColumn(
        "measure_id", F.when((c("change_type") == "increase") & (month == "01"), F.substring("geoid", 3, 10).try_cast("bigint"))
        .when((c("change_type") == "decrease") & (month == "02"), F.lit(-1).cast("bigint")))


@derived("state_profile", """
SELECT lpad(CAST(n_nationkey+1 AS VARCHAR),2,'0') AS state_usps, n_name AS state_name,
  CASE n_nationkey%3 WHEN 0 THEN 'dillon' WHEN 1 THEN 'home_rule' ELSE 'mixed' END AS home_rule_doctrine
FROM nation WHERE n_nationkey%5<>0""")
def state_profile(t):
    n = c("n_nationkey")
    return t.nation.where(n % 5 != 0).select(
        F.lpad((n + 1).cast("string"), 2, "0").alias("state_usps"), c("n_name").alias("state_name"),
        _case(n % 3, {0: "dillon", 1: "home_rule"}, "mixed").alias("home_rule_doctrine"))


@derived("claim_source", """
SELECT 'tax_instrument' AS claim_table, id AS claim_id, source_id, CASE WHEN seq%2=0 THEN 'corroborating' ELSE 'conflicting' END AS role,
  CASE WHEN seq%2=0 THEN 1 ELSE 0 END AS agrees FROM facts WHERE seq%3=0""")
def claim_source(t):
    s = c("seq")
    return t.facts.where(s % 3 == 0).select(
        F.lit("tax_instrument").alias("claim_table"), c("id").alias("claim_id"), "source_id",
        F.when(s % 2 == 0, "corroborating").otherwise("conflicting").alias("role"), F.when(s % 2 == 0, 1).otherwise(0).alias("agrees"))


@derived("archive_text", """
SELECT doc_id AS archive_file_id, text||' the rate  is '||CAST(doc_id%9 AS VARCHAR)||' percent'  AS text FROM documents""")
def archive_text(t):
    return t.documents.select(c("doc_id").alias("archive_file_id"),
                              F.concat(c("text"), F.lit(" the rate  is "), (c("doc_id") % 9).cast("string"), F.lit(" percent")).alias("text"))


@derived("work", """
SELECT w.geoid, w.category, CASE WHEN w.category='framework' AND TRY_CAST(w.geoid AS BIGINT)%3=0 THEN 'complete' ELSE w.status END AS status, w.attempts,
  CAST(floor(CASE j.kind WHEN 'state' THEN 1000 WHEN 'county' THEN 100 WHEN 'place' THEN 10 WHEN 'mcd' THEN 5 WHEN 'school' THEN 20 ELSE 1 END
    * pow(log10(CAST(coalesce(j.population,0)+10 AS DOUBLE)),2)) AS BIGINT) AS priority,
  CASE WHEN coalesce(j.population,0)%11=0 THEN 'HTTP 403' END AS last_error,
  CASE WHEN w.status='in_progress' AND w.category<>'framework' THEN TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(coalesce(j.population,0)%72 AS INT)) END AS claimed_at,
  CASE WHEN w.status IN ('complete','no_data') OR (w.category='framework' AND TRY_CAST(w.geoid AS BIGINT)%3=0) THEN TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(coalesce(j.population,0)%800 AS INT)) END AS completed_at,
  TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(coalesce(j.population,0)%500 AS INT)) AS updated_at
FROM work_item w JOIN jurisdiction j ON j.geoid=w.geoid""")
def work(t):
    pop = F.coalesce("population", F.lit(0))
    now = F.lit("2024-01-31 00:00:00").cast(NTZ)
    back = lambda n, unit: now - F.make_dt_interval(**{unit: n.cast("int")})
    w = t.work_item.join(t.jurisdiction.select("geoid", "kind", "population"), "geoid")
    filed = (c("category") == "framework") & (c("geoid").try_cast("bigint") % 3 == 0)
    w = w.withColumn("status", F.when(filed, "complete").otherwise(c("status")))
    return w.select("geoid", "category", "status", "attempts", ledger.priority(c("kind"), c("population")).alias("priority"),
                    F.when(pop % 11 == 0, "HTTP 403").alias("last_error"),
                    F.when(c("status") == "in_progress", back(pop % 72, "hours")).alias("claimed_at"),
                    F.when(c("status").isin("complete", "no_data"), back(pop % 800, "days")).alias("completed_at"),
                    back(pop % 500, "hours").alias("updated_at"))


@derived("page_log", """
SELECT event_id AS id, user_id AS run_id, state_usps AS geoid, CASE user_id%3 WHEN 0 THEN 'property' WHEN 1 THEN 'sales_use' ELSE 'elections' END AS category,
  'https://h'||CAST(user_id%37 AS VARCHAR)||'.example.gov/p/'||CAST(event_id AS VARCHAR) AS url, http_status,
  CASE WHEN http_status=403 THEN 'HTTP 403' END AS error, ts AS fetched_at FROM page_event""")
def page_log(t):
    u = c("user_id")
    return t.page_event.select(
        c("event_id").alias("id"), u.alias("run_id"), c("state_usps").alias("geoid"),
        _case(u % 3, {0: "property", 1: "sales_use"}, "elections").alias("category"),
        F.concat(F.lit("https://h"), (u % 37).cast("string"), F.lit(".example.gov/p/"), c("event_id").cast("string")).alias("url"),
        "http_status", F.when(c("http_status") == 403, "HTTP 403").alias("error"), c("ts").alias("fetched_at"))


@derived("checks", """
SELECT id, geoid, category, verdict, created_at, CASE WHEN id%7=0 THEN '{broken' WHEN verdict='flag' THEN
  '[{"code":"no_quote","instrument_code":"use_tax","reason":"r'||CAST(id%5 AS VARCHAR)||'"},{"code":"x","instrument_code":null,"reason":"b"}]' END AS flags
FROM check_result""")
def checks(t):
    i = c("id")
    return t.check_result.select(
        "id", "geoid", "category", "verdict", "created_at",
        F.when(i % 7 == 0, "{broken").when(c("verdict") == "flag", F.concat(
            F.lit('[{"code":"no_quote","instrument_code":"use_tax","reason":"r'), (i % 5).cast("string"),
            F.lit('"},{"code":"x","instrument_code":null,"reason":"b"}]'))).alias("flags"))


@derived("runs", """
SELECT run_id, started_at, status, CASE WHEN status='ok' THEN started_at + to_hours(2) END AS finished_at,
  CASE WHEN status='failed' THEN 'provider outage' END AS message, run_id%9 AS pages_fetched FROM crawl_run""")
def runs(t):
    return t.crawl_run.select("run_id", "started_at", "status",
                              F.when(c("status") == "ok", c("started_at") + F.expr("interval 2 hours")).alias("finished_at"),
                              F.when(c("status") == "failed", "provider outage").alias("message"), (c("run_id") % 9).alias("pages_fetched"))
