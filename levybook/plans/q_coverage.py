"""Queries: coverage and progress analytics (J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import coverage, pages, views
from .fixtures import AS_OF, AS_OF_TS, SQL, derived
from .registry import query

c = F.col
null = lambda k: F.lit(None).cast(k)
NOW = f"TIMESTAMP '{AS_OF_TS}'"
WJ = "work w JOIN jurisdiction j ON j.geoid=w.geoid"
POP = "coalesce(j.population,0)"


def _fn(s): return f"count(*) FILTER (WHERE w.status='{s}') AS {s}"


@query("j1_coverage_pivot", f"""SELECT j.state_usps, j.kind, w.category, {', '.join(_fn(s) for s in ('complete', 'needs_review', 'in_progress', 'pending', 'no_data', 'blocked'))}, count(*) AS total,
 CAST(sum(CASE WHEN w.status='complete' THEN {POP} ELSE 0 END) AS BIGINT) AS pop_complete, CAST(sum({POP}) AS BIGINT) AS pop_total FROM {WJ} GROUP BY 1,2,3""")
def j1(t):
    return coverage.coverage_pivot(t.work, t.jurisdiction)


@query("j2_status_by_state", f"SELECT j.state_usps, w.status, count(*) AS n, CAST(sum({POP}) AS BIGINT) AS pop FROM {WJ} GROUP BY 1,2")
def j2(t):
    return coverage.status_by_state(t.work, t.jurisdiction)


@query("j3_state_progress", f"""SELECT state_usps, items, done, round(100.0::DOUBLE*done/items,1) AS done_pct, CASE WHEN pt>0 THEN round(100.0::DOUBLE*pd/pt,2) END AS pop_pct FROM (
 SELECT j.state_usps, count(*) AS items, count(*) FILTER (WHERE w.status IN ('complete','no_data')) AS done, CAST(sum(CASE WHEN w.status IN ('complete','no_data') THEN {POP} ELSE 0 END) AS BIGINT) AS pd, CAST(sum({POP}) AS BIGINT) AS pt FROM {WJ} GROUP BY 1) x""")
def j3(t):
    return coverage.state_progress(t.work, t.jurisdiction)


@query("j3_status_shares", "SELECT status, n, round(100.0::DOUBLE*n/CAST(sum(n) OVER () AS BIGINT),1) AS share_pct FROM (SELECT status, count(*) AS n FROM work GROUP BY 1) x")
def j3b(t):
    return coverage.status_shares(t.work)


@query("j3_places_by_kind", f"SELECT kind, count(*) AS n, CAST(sum({POP}) AS BIGINT) AS pop FROM jurisdiction j GROUP BY 1")
def j3c(t):
    return coverage.places_by_kind(t.jurisdiction)


@query("j4_project_progress", f"""SELECT a.*, s.*, f.*, CASE WHEN pop_total>0 THEN round(100.0::DOUBLE*pop_done/pop_total,1) ELSE 0.0::DOUBLE END AS pop_pct FROM
 (SELECT CAST(sum({POP}) AS BIGINT) AS pop_total, CAST(sum(CASE WHEN d.geoid IS NOT NULL THEN {POP} ELSE 0 END) AS BIGINT) AS pop_done, count(*) AS juris_total, count(d.geoid) AS juris_done
  FROM jurisdiction j LEFT JOIN (SELECT DISTINCT geoid FROM work WHERE status='complete') d ON d.geoid=j.geoid WHERE j.kind IN ('county','place')) a,
 (SELECT count(*) AS states_total FROM jurisdiction WHERE kind='state') s, (SELECT count(*) AS states_done FROM {WJ} WHERE w.category='framework' AND w.status='complete') f""")
def j4(t):
    return coverage.project_progress(t.work, t.jurisdiction)


SQL["best_scope"] = """SELECT scope_geoid, completeness FROM (SELECT *, row_number() OVER (PARTITION BY scope_geoid ORDER BY CASE completeness WHEN 'complete' THEN 1 WHEN 'substantial' THEN 2 WHEN 'partial' THEN 3 WHEN 'spot_checked' THEN 4 ELSE 5 END, asserted_seq DESC) AS rn
 FROM coverage_assertion WHERE domain='ballot_measure') x WHERE rn=1"""


@query("j5_coverage_for", """SELECT p.geoid, CASE WHEN a.scope_geoid IS NOT NULL THEN p.geoid WHEN b.scope_geoid IS NOT NULL THEN p.county_fips WHEN s.scope_geoid IS NOT NULL THEN p.state_fips END AS scope_geoid,
 coalesce(a.completeness, b.completeness, s.completeness) AS completeness FROM places p LEFT JOIN best_scope a ON a.scope_geoid=p.geoid LEFT JOIN best_scope b ON b.scope_geoid=p.county_fips LEFT JOIN best_scope s ON s.scope_geoid=p.state_fips""")
def j5(t):
    return coverage.coverage_for(t.places, t.coverage_assertion)


@query("j6_list_assertions", "SELECT k.domain, k.scope_type, k.scope_geoid, k.completeness, j.name, j.state_usps FROM coverage_assertion k LEFT JOIN jurisdiction j ON j.geoid=k.scope_geoid WHERE k.completeness='partial'")
def j6(t):
    return coverage.list_assertions(t.coverage_assertion, t.jurisdiction, completeness="partial")


@query("j6_completeness_histogram", "SELECT completeness, count(*) AS n FROM coverage_assertion GROUP BY 1")
def j6b(t):
    return coverage.completeness_histogram(t.coverage_assertion)


SQL["new_verdict"] = "SELECT geoid, category, arg_max(verdict, id) AS verdict FROM checks GROUP BY 1,2"


@query("j7_auto_verified", "SELECT geoid, category FROM new_verdict WHERE verdict='pass'")
def j7(t):
    return coverage.auto_verified(t.checks)


@query("j8_header_counters", """SELECT 'jurisdictions' AS metric, count(*) AS n FROM jurisdiction UNION ALL SELECT 'ballot_measure', count(*) FROM measure_rows UNION ALL SELECT 'threshold_rule', count(*) FROM thresholds
 UNION ALL SELECT 'authority_grant', count(*) FROM grants UNION ALL SELECT 'statute_section', count(*) FROM statute_section UNION ALL SELECT 'coverage_assertion', count(*) FROM coverage_assertion UNION ALL SELECT 'pages', count(*) FROM page_log
 UNION ALL SELECT 'work_items', count(*) FROM work UNION ALL SELECT s, count(*) FILTER (WHERE w.status=s) FROM work w, (VALUES ('pending'),('in_progress'),('needs_review'),('blocked'),('awaiting_ai')) v(s) GROUP BY s
 UNION ALL SELECT 'done', count(*) FILTER (WHERE status IN ('complete','no_data')) FROM work UNION ALL SELECT 'instruments', count(*) FROM facts WHERE superseded_by IS NULL
 UNION ALL SELECT 'auto_verified', count(*) FROM new_verdict WHERE verdict='pass' UNION ALL SELECT 'runs_active', count(*) FROM runs WHERE status='running'""")
def j8(t):
    tables = {"jurisdictions": t.jurisdiction, "ballot_measure": t.measure_rows, "threshold_rule": t.thresholds, "authority_grant": t.grants,
              "statute_section": t.statute_section, "coverage_assertion": t.coverage_assertion, "pages": t.page_log}
    return coverage.header_counters(tables, t.work, t.facts, t.checks, t.runs)


@query("j9_week", f"""SELECT 'published' AS metric, count(*) AS n FROM work WHERE status='complete' AND completed_at >= {NOW} - INTERVAL 7 DAY UNION ALL SELECT 'flagged', count(*) FROM checks WHERE verdict='flag' AND created_at >= {NOW} - INTERVAL 7 DAY
 UNION ALL SELECT 'pages', count(*) FROM page_log WHERE fetched_at >= {NOW} - INTERVAL 7 DAY""")
def j9(t):
    return coverage.week(t.work, t.checks, t.page_log, AS_OF_TS)


@query("j9_finished_since", "SELECT count(*) AS finished FROM work WHERE status='complete' AND completed_at >= TIMESTAMP '2023-12-01 18:00:00'")
def j9b(t):
    return coverage.finished_since(t.work, "2023-12-01 18:00:00")


SEARCH = "(j.name ILIKE '%0001%' OR j.geoid='0001' OR j.state_usps='0001')"


@query("j10_record_chips", f"""SELECT chip, n FROM (SELECT count(*) AS "all", count(*) FILTER (WHERE w.status='needs_review') AS review, count(*) FILTER (WHERE w.status='complete') AS published, count(*) FILTER (WHERE w.status IN ('pending','in_progress','awaiting_ai')) AS working,
 count(*) FILTER (WHERE w.status='no_data') AS none, count(*) FILTER (WHERE w.status='blocked') AS stuck FROM {WJ} WHERE {SEARCH}) UNPIVOT (n FOR chip IN ("all", review, published, working, none, stuck))""")
def j10(t):
    return coverage.record_chips(t.work, t.jurisdiction, "0001")


@query("j10_record_page", f"""SELECT w.geoid, w.category, j.name, j.state_usps, j.kind, w.status, r.rate_value, r.rate_unit FROM (SELECT w.geoid, w.category, w.status FROM {WJ} WHERE w.status IN ('pending','in_progress','awaiting_ai')
  ORDER BY j.population DESC NULLS LAST, j.name, w.geoid, w.category LIMIT 50 OFFSET 50) w JOIN jurisdiction j ON j.geoid=w.geoid
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY geoid, category ORDER BY instrument_code, id) AS rn FROM facts WHERE superseded_by IS NULL AND rate_value IS NOT NULL) r ON r.geoid=w.geoid AND r.category=w.category AND r.rn=1""")
def j10b(t):
    return coverage.record_page(t.work, t.jurisdiction, t.facts, chip="working", page=2)


@query("j11_review_details", """SELECT w.geoid, w.category, w.name, w.state_usps, w.priority, h.instrument_code, h.rate_value, h.rate_unit, p.rate_value AS previous_value, p.rate_unit AS previous_unit, s.url AS source_url, s.authority_tier, v.verdict
FROM (SELECT w.geoid, w.category, j.name, j.state_usps, w.priority FROM work w JOIN jurisdiction j ON j.geoid=w.geoid WHERE w.status='needs_review' ORDER BY w.priority DESC, w.geoid, w.category LIMIT 40) w
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY geoid, category ORDER BY CASE WHEN rate_value IS NULL THEN 1 ELSE 0 END, instrument_code, id) AS rn FROM facts WHERE superseded_by IS NULL) h ON h.geoid=w.geoid AND h.category=w.category AND h.rn=1
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY geoid, category, instrument_code ORDER BY seq DESC) AS rn FROM facts WHERE superseded_by IS NOT NULL) p ON p.geoid=w.geoid AND p.category=w.category AND p.instrument_code=h.instrument_code AND p.rn=1
LEFT JOIN source s ON s.id=h.source_id LEFT JOIN new_verdict v ON v.geoid=w.geoid AND v.category=w.category""")
def j11(t):
    return coverage.review_details(t.work, t.jurisdiction, t.facts, t.source, t.checks)


def _ask_values():
    out = []
    for kind in fixed.KINDS:
        for cat in fixed.TAX_CATEGORIES:
            codes = fixed.ASK_FIRST_SALES.get(kind, fixed.ASK_FIRST_SALES["*"]) if cat == "sales_use" else fixed.ASK_FIRST[cat]
            out += [f"('{kind}','{cat}','{x}')" for x in codes]
    return "(VALUES " + ",".join(out) + ") AS x(kind, category, instrument_code)"


@derived("answers", """SELECT geoid, category, instrument_code, CASE WHEN seq%2=0 THEN 'answered' ELSE 'opened' END AS action, CASE WHEN seq%4=0 THEN TIMESTAMP '2024-01-30 20:00:00' ELSE TIMESTAMP '2024-01-30 02:00:00' END AS created_at FROM facts WHERE seq%3=0 AND superseded_by IS NULL""")
def answers(t):
    s = c("seq")
    return t.facts.where((s % 3 == 0) & c("superseded_by").isNull()).select("geoid", "category", "instrument_code", F.when(s % 2 == 0, "answered").otherwise("opened").alias("action"),
                                                                           F.when(s % 4 == 0, F.lit("2024-01-30 20:00:00")).otherwise(F.lit("2024-01-30 02:00:00")).cast("timestamp_ntz").alias("created_at"))


@query("j12_gap_list", f"""SELECT geoid, category, instrument_code, reason, note FROM (
 SELECT w.geoid, w.category, x.instrument_code, CASE WHEN f.id IS NULL THEN 'nothing_on_file' WHEN f.status='unknown' THEN 'unknown' WHEN f.status='levied' AND f.rate_value IS NULL THEN 'levied_without_rate' WHEN f.confidence='low' THEN 'low_confidence' END AS reason,
  CASE WHEN f.id IS NULL THEN w.last_error END AS note, coalesce((f.status='levied' AND (f.rate_value IS NOT NULL OR x.instrument_code IN ('assessment_ratio','homestead_exemption'))) OR f.status IN ('authorized_not_levied','prohibited','repealed'), FALSE) AS done, f.confidence
 FROM work w JOIN jurisdiction j ON j.geoid=w.geoid JOIN {_ask_values()} ON x.kind=j.kind AND x.category=w.category
 LEFT JOIN facts f ON f.superseded_by IS NULL AND f.geoid=w.geoid AND f.category=w.category AND f.instrument_code=x.instrument_code
 WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.geoid=w.geoid AND a.category=w.category AND a.instrument_code=x.instrument_code AND a.action IN ('skipped','skip_rest','answered','unknown') AND a.created_at >= {NOW} - INTERVAL 12 HOUR)) y
WHERE (NOT done OR confidence='low') AND reason IS NOT NULL""")
def j12(t):
    return coverage.gap_list(t.work, t.jurisdiction, t.facts, t.answers, AS_OF_TS)


@derived("uploads", """SELECT event_id AS id, lpad(CAST(user_id%25+1 AS VARCHAR),2,'0') AS geoid, 'property' AS category, CASE WHEN event_id%5=0 THEN 'https://h1.example.gov/shared' ELSE 'intake:f'||CAST(event_id AS VARCHAR) END AS url,
 CASE WHEN event_id%3=0 THEN 'failed' ELSE 'ok' END AS status, 'unreadable' AS error, ts AS created_at, CAST(NULL AS TIMESTAMP) AS finished_at FROM events WHERE event_type='signup'""")
def uploads(t):
    e = c("event_id")
    return t.events.where(c("event_type") == "signup").select(e.alias("id"), F.lpad((c("user_id") % 25 + 1).cast("string"), 2, "0").alias("geoid"), F.lit("property").alias("category"),
                                                            F.when(e % 5 == 0, "https://h1.example.gov/shared").otherwise(F.concat(F.lit("intake:f"), e.cast("string"))).alias("url"),
                                                            F.when(e % 3 == 0, "failed").otherwise("ok").alias("status"), F.lit("unreadable").alias("error"), c("ts").alias("created_at"), null("timestamp_ntz").alias("finished_at"))


AGENCY = "SELECT state_usps, 'https://revenue.st'||state_usps||'.gov' AS url FROM state_profile"


@query("j13_citations", f"""SELECT geoid, url, origin FROM (SELECT *, row_number() OVER (PARTITION BY geoid, url ORDER BY o, rk) AS keep FROM (
 SELECT geoid, url, 'intake' AS origin, 0 AS o, rk FROM (SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY id DESC) AS rk FROM uploads) a WHERE rk<=8
 UNION ALL SELECT geoid, url, 'crawl', 1, rk FROM (SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY id DESC) AS rk FROM page_log WHERE url NOT LIKE 'file:%') b WHERE rk<=8
 UNION ALL SELECT scope_geoid, url, 'catalog', 2, rk FROM (SELECT *, row_number() OVER (PARTITION BY scope_geoid ORDER BY authority_tier, id) AS rk FROM source WHERE scope_geoid IS NOT NULL) k WHERE rk<=6
 UNION ALL SELECT j.geoid, g.url, 'agency', 3, 1 FROM jurisdiction j JOIN ({AGENCY}) g ON g.state_usps=j.state_usps) u) z WHERE keep=1""")
def j13(t):
    ag = t.state_profile.select("state_usps", F.concat(F.lit("https://revenue.st"), c("state_usps"), F.lit(".gov")).alias("url"))
    return coverage.citations(t.jurisdiction, t.uploads, t.page_log, t.source, ag)


@query("j14_urgent_names", f"SELECT j.name, max(w.priority) AS priority FROM {WJ} WHERE w.status='needs_review' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def j14(t):
    return coverage.urgent_names(t.work, t.jurisdiction)


@query("j14_newest_blocked", f"SELECT w.geoid, w.category, j.name, j.state_usps, w.updated_at FROM {WJ} WHERE w.status='blocked' ORDER BY w.updated_at DESC, w.geoid, w.category LIMIT 3")
def j14b(t):
    return coverage.newest_blocked(t.work, t.jurisdiction)


def _agg(v, o): return f"string_agg({v}, '; ' ORDER BY {o})"


SQL["statute_hits"] = " UNION ALL ".join(
    f"SELECT state_usps, '{k}' AS category, citation, section_title, doc_id, row_number() OVER (PARTITION BY state_usps ORDER BY citation, doc_id) AS rn FROM statutes WHERE "
    + " OR ".join(f"{f} ILIKE '%{w}%'" for w in v for f in ("section_title", "text", "citation")) for k, v in fixed.STATUTE_TERMS.items())
SRC3 = """(SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY authority_tier, id) AS rn FROM (SELECT DISTINCT p.geoid, s.id, s.url, s.authority_tier FROM places p JOIN source s ON s.scope_geoid IN (p.geoid, p.state_fips, p.county_fips)) q)"""


@query("j15_research_context", f"""SELECT w.geoid, w.category, j.state_usps, pr.home_rule_doctrine AS doctrine, coalesce(k.txt,'') AS known, coalesce(s.txt,'') AS sources, coalesce(b.txt,'') AS priors, coalesce(h.txt,'') AS statutes
FROM work w JOIN jurisdiction j ON j.geoid=w.geoid
LEFT JOIN (SELECT geoid, category, {_agg("concat_ws(' ', instrument_code, status, CAST(rate_value AS VARCHAR), rate_unit)", 'instrument_code, id')} AS txt FROM (SELECT *, row_number() OVER (PARTITION BY geoid, category ORDER BY instrument_code, id) AS rn FROM facts WHERE superseded_by IS NULL) f WHERE rn<=60 GROUP BY 1,2) k ON k.geoid=w.geoid AND k.category=w.category
LEFT JOIN (SELECT geoid, {_agg('url', 'rn')} AS txt FROM {SRC3} r WHERE rn<=25 GROUP BY 1) s ON s.geoid=w.geoid
LEFT JOIN (SELECT geoid, {_agg("CAST(fiscal_year AS VARCHAR)||' '||base_type||'='||CAST(base_value AS VARCHAR)", 'fiscal_year, base_type')} AS txt FROM base_rows GROUP BY 1) b ON b.geoid=w.geoid
LEFT JOIN (SELECT state_usps, category, {_agg('citation', 'rn')} AS txt FROM statute_hits GROUP BY 1,2) h ON h.state_usps=j.state_usps AND h.category=w.category
LEFT JOIN state_profile pr ON pr.state_usps=j.state_usps WHERE w.category NOT IN ('framework','elections')""")
def j15(t):
    hits = pages.statutes_by_category(t.statutes)
    hits = hits.groupBy("state_usps", "category").agg(F.array_sort(F.collect_list(F.struct("citation", "doc_id"))).alias("l")) \
        .select("state_usps", "category", F.transform("l", lambda x: x["citation"]).alias("statutes"))
    r = coverage.research_context(t.work.select("geoid", "category"), t.places, t.facts, t.source, t.base_rows, hits, t.state_profile)
    return _texts(r, ("known", "sources", "priors", "statutes"))


def _texts(df, cols):
    for x in cols:
        df = df.withColumn(x, F.array_join(x, "; "))
    return df


@query("j16_framework_context", f"""SELECT w.geoid, j.state_usps, coalesce(nt.n,0) AS n_thresholds, coalesce(ng.n,0) AS n_grants, coalesce(th.txt,'') AS thresholds, coalesce(gr.txt,'') AS grants, coalesce(s.txt,'') AS sources
FROM work w JOIN jurisdiction j ON j.geoid=w.geoid AND j.kind='state'
LEFT JOIN (SELECT state_usps, count(*) AS n FROM thresholds GROUP BY 1) nt ON nt.state_usps=j.state_usps LEFT JOIN (SELECT state_usps, count(*) AS n FROM grants GROUP BY 1) ng ON ng.state_usps=j.state_usps
LEFT JOIN (SELECT state_usps, {_agg("concat_ws(' ', measure_class, coalesce(jurisdiction_kind,'any'), CAST(threshold_value AS VARCHAR))", 'rn')} AS txt FROM (SELECT *, row_number() OVER (PARTITION BY state_usps ORDER BY measure_class, id) AS rn FROM thresholds) a WHERE rn<=40 GROUP BY 1) th ON th.state_usps=j.state_usps
LEFT JOIN (SELECT state_usps, {_agg("concat_ws(' ', category, instrument_code, permitted)", 'rn')} AS txt FROM (SELECT *, row_number() OVER (PARTITION BY state_usps ORDER BY category, id) AS rn FROM grants) a WHERE rn<=40 GROUP BY 1) gr ON gr.state_usps=j.state_usps
LEFT JOIN (SELECT scope_geoid, {_agg('url', 'rn')} AS txt FROM (SELECT *, row_number() OVER (PARTITION BY scope_geoid ORDER BY authority_tier, id) AS rn FROM source) a WHERE rn<=30 GROUP BY 1) s ON s.scope_geoid=w.geoid WHERE w.category='framework'""")
def j16(t):
    return _texts(coverage.framework_context(t.work.select("geoid", "category"), t.places, t.thresholds, t.grants, t.source), ("thresholds", "grants", "sources"))


@query("j16_elections_context", f"""SELECT w.geoid, p.state_usps, coalesce(m.txt,'') AS measures, coalesce(th.txt,'') AS thresholds, coalesce(s.txt,'') AS sources FROM work w JOIN places p ON p.geoid=w.geoid
LEFT JOIN (SELECT geoid, {_agg("concat_ws(' ', election_date, measure_class, outcome)", 'rn')} AS txt FROM (SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY election_date DESC, id DESC) AS rn FROM county_measures WHERE superseded_by IS NULL) a WHERE rn<=40 GROUP BY 1) m ON m.geoid=w.geoid
LEFT JOIN (SELECT state_usps, {_agg("concat_ws(' ', measure_class, CAST(threshold_value AS VARCHAR))", 'r2')} AS txt FROM (SELECT *, row_number() OVER (PARTITION BY state_usps ORDER BY measure_class, id) AS r2 FROM live_threshold) a WHERE r2<=40 GROUP BY 1) th ON th.state_usps=p.state_usps
LEFT JOIN (SELECT geoid, {_agg('url', 'rn')} AS txt FROM (SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY authority_tier, id) AS rn FROM (SELECT p.geoid, s.id, s.url, s.authority_tier FROM places p JOIN source s ON s.scope_geoid IN (p.geoid, p.state_fips)) q) r WHERE rn<=20 GROUP BY 1) s ON s.geoid=w.geoid
WHERE w.category='elections'""")
def j16b(t):
    return _texts(coverage.elections_context(t.work.select("geoid", "category"), t.places, _county_measures(t), views.live_thresholds(t.thresholds, AS_OF), t.source), ("measures", "thresholds", "sources"))


#: Every measure belongs to a county of its state: the counties are numbered and the measure's id picks one; a state without any holds its measures itself.
SQL["county_measures"] = """WITH n AS (SELECT geoid, substr(geoid,1,2) AS st, row_number() OVER (PARTITION BY substr(geoid,1,2) ORDER BY geoid)-1 AS nth, count(*) OVER (PARTITION BY substr(geoid,1,2)) AS n FROM jurisdiction WHERE kind='county')
SELECT coalesce(k.geoid, m.geoid) AS geoid, m.election_date, m.measure_class, m.outcome, m.id, m.superseded_by FROM measure_rows m LEFT JOIN (SELECT DISTINCT st, n FROM n) z ON z.st=substr(m.geoid,1,2) LEFT JOIN n k ON k.st=z.st AND k.nth=m.id%z.n"""


def _county_measures(t):
    st = F.substring("geoid", 1, 2)
    by = Window.partitionBy("st")
    n = t.jurisdiction.where(c("kind") == "county").select(c("geoid").alias("county"), st.alias("st")) \
        .withColumn("nth", (F.row_number().over(by.orderBy("county")) - 1).cast("bigint")).withColumn("n", F.count("*").over(by))
    m = t.measure_rows.withColumn("st", st).join(n.select("st", "n").distinct(), "st", "left").withColumn("nth", c("id") % c("n"))
    return m.join(n.select("st", "nth", "county"), ["st", "nth"], "left").withColumn("geoid", F.coalesce("county", "geoid"))


@query("j17_packets", """SELECT geoid, string_agg(category, ',' ORDER BY category) AS categories FROM (SELECT DISTINCT geoid, category FROM work WHERE status='pending' AND category NOT IN ('framework','elections')) x GROUP BY 1
 UNION ALL SELECT geoid, category FROM work WHERE status='pending' AND category IN ('framework','elections')""")
def j17(t):
    return coverage.packets(t.work.where(c("status") == "pending")).withColumn("categories", F.array_join("categories", ","))


@query("j18_item_sources", """WITH hit AS (SELECT w.geoid, w.category, s.url, s.authority_tier, s.categories IS NOT NULL AS tagged FROM work w JOIN places p ON p.geoid=w.geoid JOIN source s ON s.scope_geoid IN (p.geoid, p.state_fips, p.county_fips)
  WHERE s.categories IS NULL OR contains(','||s.categories||',', ','||w.category||','))
SELECT h.geoid, h.category, h.url, h.authority_tier, k.covered, CASE WHEN EXISTS (SELECT 1 FROM page_log g WHERE g.geoid=h.geoid AND g.category=h.category) THEN 1 ELSE 0 END AS crawled
FROM hit h JOIN (SELECT geoid, category, CAST(bool_or(tagged) AS INT) AS covered FROM hit GROUP BY 1,2) k ON k.geoid=h.geoid AND k.category=h.category""")
def j18(t):
    return coverage.item_sources(t.work.select("geoid", "category"), t.places, t.source, t.page_log)
