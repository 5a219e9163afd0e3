"""Queries: version-preserving merges and as-of resolution (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge
from .fixtures import SQL, derived
from .registry import query

c = F.col
null = lambda k: F.lit(None).cast(k)


@query("d1_supersede_merge", """
WITH a AS (SELECT *, max(effective_date) OVER (PARTITION BY geoid, instrument_code ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM rate_arrival),
b AS (SELECT *, coalesce(effective_date>=top, TRUE) AS became_live FROM a)
SELECT geoid, category, instrument_code, arrival_seq, seq, became_live, CASE WHEN became_live
  THEN min(CASE WHEN became_live THEN arrival_seq END) OVER (PARTITION BY geoid, instrument_code ORDER BY arrival_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
  ELSE max(CASE WHEN became_live THEN arrival_seq END) OVER (PARTITION BY geoid, instrument_code ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS superseded_by FROM b""")
def d1(t):
    return merge.supersede(t.rate_arrival, bare_years=False).select(
        "geoid", "category", "instrument_code", "arrival_seq", "seq", "became_live", "superseded_by")


@derived("mixed_arrival", """
SELECT geoid, category, instrument_code, arrival_seq, CASE WHEN arrival_seq%3<>0 THEN effective_date END AS effective_date,
  CASE WHEN arrival_seq%11<>0 THEN CAST(substr(effective_date,1,4) AS BIGINT) END AS fiscal_year FROM rate_arrival""")
def mixed_arrival(t):
    a = c("arrival_seq")
    return t.rate_arrival.select("geoid", "category", "instrument_code", a, F.when(a % 3 != 0, c("effective_date")).alias("effective_date"),
                                 F.when(a % 11 != 0, F.substring("effective_date", 1, 4).cast("bigint")).alias("fiscal_year"))


@query("d1_supersede_bare_years", """
WITH RECURSIVE fold AS (
 SELECT DISTINCT geoid, instrument_code, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS live, CAST(NULL AS VARCHAR) AS le, CAST(NULL AS BIGINT) AS ly FROM mixed_arrival
 UNION ALL SELECT geoid, instrument_code, n+1, CASE WHEN older THEN live ELSE n+1 END, CASE WHEN older THEN le ELSE e END, CASE WHEN older THEN ly ELSE y END
 FROM (SELECT f.*, r.effective_date AS e, coalesce(CAST(substr(r.effective_date,1,4) AS BIGINT), r.fiscal_year) AS y,
   coalesce(CASE WHEN r.effective_date IS NOT NULL AND f.le IS NOT NULL THEN r.effective_date<f.le
     ELSE coalesce(CAST(substr(r.effective_date,1,4) AS BIGINT), r.fiscal_year)<f.ly END, FALSE) AS older
   FROM fold f JOIN mixed_arrival r ON r.geoid=f.geoid AND r.instrument_code=f.instrument_code AND r.arrival_seq=f.n+1) s)
SELECT geoid, instrument_code, n AS arrival_seq, live=n AS became_live, CASE WHEN live<>n THEN live ELSE
  min(CASE WHEN live=n THEN n END) OVER (PARTITION BY geoid, instrument_code ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS superseded_by
FROM fold WHERE n>0""")
def d1_bare(t):
    # arrivals are stored in columns: the shuffles that number them are gone before they are gathered
    return merge.supersede(t.store("mixed_arrival").mixed_arrival, chunk_rows=32, only=[]).select("geoid", "instrument_code", "arrival_seq", "became_live", "superseded_by")


TH = ["state_usps", "jurisdiction_kind", "measure_class", "instrument_code", "purpose_restriction", "effective_from",
      "threshold_value", "threshold_basis", "statute_cite", "effective_to", "confidence"]


def _fold(keys, cols, src):
    aggs = ", ".join(f"arg_max({x}, seq) FILTER (WHERE {x} IS NOT NULL) AS {x}" for x in cols)
    return f"SELECT {', '.join(keys)}, {aggs} FROM ({src}) u GROUP BY {', '.join(keys)}"


@query("d2_threshold_upsert", _fold(merge.THRESHOLD_KEY, TH[6:], f"SELECT {', '.join(TH)}, id + CASE WHEN id%2=0 THEN 0 ELSE 1000000000 END AS seq FROM thresholds"))
def d2(t):
    rows = t.thresholds.select(*TH, (c("id") + F.when(c("id") % 2 == 0, 0).otherwise(1000000000)).alias("seq"), "id")
    return merge.upsert_thresholds(rows.where(c("id") % 2 == 0).drop("id"), rows.where(c("id") % 2 != 0).drop("id"))


GR = ["state_usps", "jurisdiction_kind", "category", "instrument_code", "effective_from", "permitted", "max_rate", "max_rate_unit",
      "stacking_rule", "statute_cite", "effective_to", "confidence"]


@query("d3_grant_upsert", _fold(merge.GRANT_KEY, GR[5:], f"SELECT {', '.join(GR)}, id + CASE WHEN id%2=0 THEN 0 ELSE 1000000000 END AS seq FROM grants"))
def d3(t):
    rows = t.grants.select(*GR, (c("id") + F.when(c("id") % 2 == 0, 0).otherwise(1000000000)).alias("seq"), "id")
    return merge.upsert_grants(rows.where(c("id") % 2 == 0).drop("id"), rows.where(c("id") % 2 != 0).drop("id"))


@derived("measure_updates", """
SELECT geoid, election_date, CASE WHEN id%9<>0 THEN measure_id_local END AS measure_id_local, CASE WHEN id%9=0 THEN 'T'||CAST(id%4 AS VARCHAR) END AS official_title,
  outcome, votes_yes, pct_yes, id AS seq FROM measure_rows WHERE id%2=0
UNION ALL SELECT geoid, election_date, CASE WHEN id%9<>0 THEN measure_id_local END, CASE WHEN id%9=0 THEN 'T'||CAST(id%4 AS VARCHAR) END,
  'invalidated', CASE WHEN id%5=0 THEN votes_yes+1 END, CASE WHEN id%6=0 THEN CAST(12.5 AS DOUBLE) END, id+1000000000 FROM measure_rows WHERE id%3=0""")
def measure_updates(t):
    i = c("id")
    m = t.measure_rows.withColumn("official_title", F.when(i % 9 == 0, F.concat(F.lit("T"), (i % 4).cast("string")))) \
        .withColumn("measure_id_local", F.when(i % 9 != 0, c("measure_id_local")))
    key = ["geoid", "election_date", "measure_id_local", "official_title"]
    a = m.where(i % 2 == 0).select(*key, "outcome", "votes_yes", "pct_yes", i.alias("seq"))
    b = m.where(i % 3 == 0).select(*key, F.lit("invalidated").alias("outcome"), F.when(i % 5 == 0, c("votes_yes") + 1).alias("votes_yes"),
                                   F.when(i % 6 == 0, F.lit(12.5)).alias("pct_yes"), (i + 1000000000).alias("seq"))
    return a.unionByName(b)


@query("d4_measure_upsert", """SELECT geoid, election_date, measure_id_local, CASE WHEN measure_id_local IS NULL THEN t END AS official_title,
 arg_max(outcome, seq) FILTER (WHERE outcome IS NOT NULL) AS outcome, arg_max(votes_yes, seq) FILTER (WHERE votes_yes IS NOT NULL) AS votes_yes,
 arg_max(pct_yes, seq) FILTER (WHERE pct_yes IS NOT NULL) AS pct_yes
FROM (SELECT *, CASE WHEN measure_id_local IS NULL THEN coalesce(official_title,'') ELSE '' END AS t FROM measure_updates) u GROUP BY geoid, election_date, measure_id_local, t""")
def d4(t):
    m = t.measure_updates
    return merge.upsert_measures(m.where(c("seq") < 1000000000), m.where(c("seq") >= 1000000000))


@query("d5_profile_patch", """SELECT state_usps, coalesce(max(state_name), state_usps) AS state_name,
  arg_max(home_rule_doctrine, seq) FILTER (WHERE home_rule_doctrine IS NOT NULL) AS home_rule_doctrine,
  arg_max(revenue_agency, seq) FILTER (WHERE revenue_agency IS NOT NULL) AS revenue_agency,
  arg_max(verified_by, seq) FILTER (WHERE verified_by IS NOT NULL) AS verified_by, arg_max(verified_at, seq) FILTER (WHERE verified_at IS NOT NULL) AS verified_at
FROM (SELECT state_usps, state_name, home_rule_doctrine, NULL AS revenue_agency, NULL AS verified_by, NULL AS verified_at, CAST(-1 AS BIGINT) AS seq FROM state_profile
 UNION ALL SELECT lpad(CAST(s_nationkey+1 AS VARCHAR),2,'0'), NULL, CASE WHEN s_suppkey%4=0 THEN 'mixed' END, CASE WHEN s_suppkey%3=0 THEN s_name END, 'r'||CAST(s_suppkey AS VARCHAR), '1998-06-30', s_suppkey
 FROM supplier WHERE s_suppkey%4=0 OR s_suppkey%3=0) u GROUP BY state_usps""")
def d5(t):
    k = c("s_suppkey")
    old = t.state_profile.select("state_usps", "state_name", "home_rule_doctrine", null("string").alias("revenue_agency"),
                                 null("string").alias("verified_by"), null("string").alias("verified_at"), F.lit(-1).cast("bigint").alias("seq"))
    new = t.supplier.select(F.lpad((c("s_nationkey") + 1).cast("string"), 2, "0").alias("state_usps"),
                            F.when(k % 4 == 0, "mixed").alias("home_rule_doctrine"), F.when(k % 3 == 0, c("s_name")).alias("revenue_agency"),
                            F.concat(F.lit("r"), k.cast("string")).alias("verified_by"), F.lit("1998-06-30").alias("verified_at"), k.alias("seq"))
    return merge.patch_profiles(old, new)


MEAS = "id, votes_total, pct_yes, turnout_pct, threshold_required, threshold_basis, threshold_rule_id, margin_vs_threshold"


@query("d6_vote_arithmetic", f"SELECT {MEAS} FROM measures")
def d6(t):
    return t.measures.select(*MEAS.split(", "))


@query("d7_threshold_for", "SELECT * FROM measure_rule")
def d7(t):
    return t.measure_rule


SQL["cites"] = """
SELECT claim_table, claim_id, source_id, role, observed_value, CASE WHEN role IN ('primary','corroborating') THEN 1 ELSE 0 END AS agrees FROM (
 SELECT *, row_number() OVER (PARTITION BY claim_table, claim_id, source_id, role ORDER BY pos) AS rn FROM (
  SELECT 'tax_instrument' AS claim_table, id AS claim_id, source_id, 'primary' AS role, source_quote AS observed_value, 0 AS pos FROM facts WHERE source_id IN (SELECT id FROM source)
  UNION ALL SELECT 'tax_instrument', f.id, s.id, CASE WHEN f.seq%4=0 THEN 'conflicting' ELSE 'corroborating' END, CAST(f.rate_value AS VARCHAR), 1 FROM facts f JOIN source s ON s.id=f.source_id+1 WHERE f.seq%2=0) u) x WHERE rn=1"""


@query("d8_cite_claims", """SELECT claim_table, claim_id, source_id, role, agrees FROM cites k WHERE NOT EXISTS (SELECT 1 FROM claim_source h
 WHERE h.claim_id=k.claim_id AND h.source_id=k.source_id AND h.role=k.role)""")
def d8(t):
    s1 = t.source.select(c("id").alias("source_id"))
    s2 = t.source.select((c("id") - 1).alias("source_id"), c("id").alias("_second"))
    role = F.when(c("seq") % 4 == 0, "conflicting")
    extra = F.struct(c("_second").alias("source_id"), role.alias("role"), c("rate_value").cast("string").alias("observed_value"))
    claims = t.facts.join(s1, "source_id").join(s2, "source_id", "left").select(
        F.lit("tax_instrument").alias("claim_table"), c("id").alias("claim_id"), "source_id", "source_quote",
        F.when((c("seq") % 2 == 0) & c("_second").isNotNull(), F.array(extra)).alias("corroborating"))
    return merge.cite_claims(t.claim_source, claims).drop("observed_value")


@query("d9_touch_items", """SELECT w.geoid, w.category, CASE WHEN b.geoid IS NULL THEN 'needs_review' ELSE 'complete' END AS status,
 CASE WHEN b.geoid IS NOT NULL THEN 'filled from a published bulk rate file; no human review needed' END AS last_error
FROM (SELECT DISTINCT geoid, category FROM facts WHERE seq%2=0) w JOIN jurisdiction j ON j.geoid=w.geoid
LEFT JOIN (SELECT DISTINCT geoid, category FROM facts WHERE superseded_by IS NULL AND extraction_method='bulk_import') b ON b.geoid=w.geoid AND b.category=w.category""")
def d9(t):
    return merge.touch_items(t.facts.where(c("seq") % 2 == 0), t.jurisdiction, t.facts)


SQL["all_measures"] = """SELECT geoid FROM measures UNION ALL SELECT geoid FROM facts WHERE category='property'"""


@query("d10_measure_items", """SELECT DISTINCT m.geoid, 'elections' AS category FROM all_measures m LEFT JOIN jurisdiction j ON j.geoid=m.geoid
WHERE j.kind='county' OR EXISTS (SELECT 1 FROM work_item w WHERE w.geoid=m.geoid AND w.category='elections')""")
def d10(t):
    m = t.measures.select("geoid").unionByName(t.facts.where(c("category") == "property").select("geoid"))
    return merge.measure_items(m, t.jurisdiction, t.work_item)


SQL["partials"] = """SELECT 'ballot_measure' AS domain, CASE j.kind WHEN 'state' THEN 'state' WHEN 'county' THEN 'county' ELSE 'place' END AS scope_type,
 m.geoid AS scope_geoid, 'partial' AS completeness, m.n AS measures_found FROM (SELECT geoid, count(*) AS n FROM all_measures GROUP BY 1) m LEFT JOIN jurisdiction j ON j.geoid=m.geoid"""


def _partials(t):
    m = t.measures.select("geoid").unionByName(t.facts.where(c("category") == "property").select("geoid"))
    return merge.partial_coverage(m, t.jurisdiction)


@query("d11_coverage_if_absent", """SELECT * FROM coverage_assertion UNION ALL SELECT domain, scope_type, scope_geoid, completeness, measures_found FROM partials p
 WHERE NOT EXISTS (SELECT 1 FROM coverage_assertion h WHERE h.domain=p.domain AND h.scope_type=p.scope_type AND h.scope_geoid=p.scope_geoid)""")
def d11(t):
    new = _partials(t).withColumnRenamed("measures_found", "asserted_seq")
    return merge.assert_coverage(t.coverage_assertion, new, only_if_absent=True)


@query("d11_coverage_replace", """SELECT * FROM coverage_assertion h WHERE NOT EXISTS (SELECT 1 FROM partials p WHERE h.domain=p.domain AND h.scope_type=p.scope_type AND h.scope_geoid=p.scope_geoid)
 UNION ALL SELECT domain, scope_type, scope_geoid, completeness, measures_found FROM partials""")
def d11b(t):
    return merge.assert_coverage(t.coverage_assertion, _partials(t).withColumnRenamed("measures_found", "asserted_seq"))


@query("d12_partial_coverage", "SELECT * FROM partials")
def d12(t):
    return _partials(t)


@query("d13_state_stubs", """SELECT 'ballot_measure' AS domain, 'state' AS scope_type, j.geoid AS scope_geoid, 'none' AS completeness FROM jurisdiction j WHERE j.kind='state'
 AND NOT EXISTS (SELECT 1 FROM coverage_assertion h WHERE h.completeness IN ('complete','partial') AND h.scope_type='state' AND h.scope_geoid=j.geoid)""")
def d13(t):
    held = t.coverage_assertion.where(c("completeness").isin("complete", "partial"))
    return merge.state_stubs(held, t.jurisdiction.where(c("kind") == "state").select(c("geoid").alias("fips")))


@query("d14_settle_empty", """SELECT geoid, category, CASE WHEN category='elections' AND attempts%2=0 THEN 'no_data' ELSE 'needs_review' END AS status,
 CASE WHEN category='elections' AND attempts%2=0 THEN 'spot_checked' END AS completeness, CASE WHEN category='elections' AND attempts%2=0 THEN CAST(0 AS BIGINT) END AS measures_found
FROM work_item WHERE attempts%3=0""")
def d14(t):
    return merge.settle_empty(t.work_item.withColumn("written", c("attempts") % 3).withColumn("rejected", c("attempts") % 2))


SQL["bases"] = """SELECT geoid, fiscal_year, CASE item WHEN 'T01' THEN 'collections_property' WHEN 'T09' THEN 'collections_sales_use' WHEN 'T19' THEN 'collections_lodging_meals' ELSE 'collections_income_payroll' END AS base_type,
 amount_thousands*1000 AS base_value, 'usd' AS base_unit, 'v1' AS vintage FROM (SELECT *, row_number() OVER (PARTITION BY geoid, fiscal_year, item ORDER BY line_no DESC) AS rn FROM revenue_base) x WHERE rn=1"""


@derived("base_rows", SQL["bases"])
def base_rows(t):
    return merge.revenue_bases(t.revenue_base, t.jurisdiction, "v1")


@query("d15_revenue_bases", "SELECT geoid, CAST(fiscal_year AS BIGINT) AS fiscal_year, base_type, base_value, base_unit, vintage FROM bases")
def d15(t):
    return t.base_rows.withColumn("fiscal_year", c("fiscal_year").cast("bigint"))


@query("d15_replace_vintage", "SELECT geoid, base_type, base_value, 'v0' AS vintage FROM bases WHERE fiscal_year=1996 UNION ALL SELECT geoid, base_type, base_value, vintage FROM bases WHERE fiscal_year=1998")
def d15b(t):
    b = t.base_rows.select("geoid", "base_type", "base_value", "vintage", "fiscal_year")
    old = b.where(c("fiscal_year").isin(1996, 1997)).withColumn("vintage", F.when(c("fiscal_year") == 1996, "v0").otherwise("v1"))
    return merge.replace_vintage(old, b.where(c("fiscal_year") == 1998), "v1").drop("fiscal_year")


@query("d15_replace_vintage_all", "SELECT geoid, CAST(fiscal_year AS BIGINT) AS fiscal_year, base_type, base_value, CASE WHEN fiscal_year%3=0 THEN 'v0' ELSE 'v1' END AS vintage FROM bases WHERE fiscal_year%3<>1")
def d15c(t):
    """All years: a third held under another vintage, a third held and replaced, a third fresh."""
    b, third = t.base_rows.select("geoid", c("fiscal_year").cast("bigint").alias("fiscal_year"), "base_type", "base_value", "vintage"), c("fiscal_year") % 3
    return merge.replace_vintage(b.where(third != 2).withColumn("vintage", F.when(third == 0, "v0").otherwise("v1")), b.where(third == 2), "v1")
