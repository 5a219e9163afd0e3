"""Queries: integrity checks (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import kept
from ..operators import checks
from .fixtures import AS_OF, SQL
from .registry import query

c = F.col
LIVE = "facts t WHERE t.superseded_by IS NULL"
K3 = "t.geoid||'|'||t.instrument_code||'|'||t.id"
TIER4 = "facts t JOIN source s ON s.id=t.source_id WHERE t.superseded_by IS NULL AND s.authority_tier=4"
ISO_DAY = r"regexp_matches(t.expiration_date, '^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$')"
WORK = "w.geoid||'|'||w.category"

ORACLES = {
    "g01": f"SELECT {K3} AS key FROM facts t LEFT JOIN source s ON s.id=t.source_id WHERE t.superseded_by IS NULL AND coalesce(s.url,'')=''",
    "g02": f"SELECT {K3} AS key FROM {LIVE} AND t.status='levied' AND t.rate_value IS NULL",
    "g03": f"SELECT {K3} AS key FROM {LIVE} AND t.rate_value IS NOT NULL AND t.rate_unit IS NULL",
    "g04": f"SELECT {K3} AS key FROM {LIVE} AND t.rate_unit='percent' AND (t.rate_value<0 OR t.rate_value>25)",
    "g05": f"SELECT {K3} AS key FROM {LIVE} AND t.rate_unit IS NOT DISTINCT FROM t.cap_unit AND t.rate_value>t.cap_value",
    "g06": f"SELECT {K3} AS key FROM {TIER4}",
    "g07": f"SELECT {WORK} AS key FROM work w WHERE w.status='complete' AND w.category NOT IN ('framework','elections') AND NOT EXISTS (SELECT 1 FROM facts t WHERE t.geoid=w.geoid AND t.category=w.category AND t.superseded_by IS NULL)",
    "g08": f"SELECT {WORK} AS key FROM work w JOIN jurisdiction j ON j.geoid=w.geoid WHERE w.status='complete' AND w.category='framework' AND NOT EXISTS (SELECT 1 FROM thresholds r WHERE r.state_usps=j.state_usps) AND NOT EXISTS (SELECT 1 FROM grants g WHERE g.state_usps=j.state_usps) AND NOT EXISTS (SELECT 1 FROM state_profile p WHERE p.state_usps=j.state_usps)",
    "g09": f"SELECT {WORK} AS key FROM work w WHERE w.status='complete' AND w.category='elections' AND NOT EXISTS (SELECT 1 FROM measures b WHERE b.geoid=w.geoid) AND NOT EXISTS (SELECT 1 FROM coverage_assertion k WHERE k.domain='ballot_measure' AND k.scope_geoid=w.geoid)",
    "g10": f"SELECT {K3} AS key FROM {LIVE} AND t.retrieved_at < CAST(DATE '{AS_OF}' - INTERVAL 400 DAY AS DATE)::VARCHAR",
    "g11": f"SELECT {K3} AS key FROM {LIVE} AND t.expiration_date IS NOT NULL AND NOT {ISO_DAY}",
    "g12": "SELECT CAST(id AS VARCHAR) AS key FROM measures WHERE outcome='passed' AND margin_vs_threshold<0",
    "g13": "SELECT CAST(id AS VARCHAR) AS key FROM measures WHERE votes_total>0 AND abs(pct_yes-100.0::DOUBLE*votes_yes/votes_total)>0.15",
    "g14": "SELECT geoid||'|'||instrument_code||'|'||change_type||'|'||effective_period AS key FROM rate_change e WHERE measure_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM measures b WHERE b.id=e.measure_id)",
    "g15": f"SELECT t.id AS key FROM {TIER4} AND NOT EXISTS (SELECT 1 FROM claim_source k WHERE k.claim_table='tax_instrument' AND k.claim_id=t.id AND k.role='corroborating' AND k.agrees=1)",
    "g16": "SELECT CAST(id AS VARCHAR) AS key FROM thresholds WHERE threshold_value<=1.0",
    "g17": "SELECT 'threshold|'||CAST(id AS VARCHAR) AS key FROM thresholds WHERE statute_cite IS NULL OR trim(statute_cite)='' UNION ALL SELECT 'grant|'||CAST(id AS VARCHAR) FROM grants WHERE statute_cite IS NULL OR trim(statute_cite)=''",
    "g18": "SELECT CAST(id AS VARCHAR) AS key FROM grants WHERE max_rate IS NOT NULL AND coalesce(max_rate_unit,'')=''",
    "g19": "SELECT CAST(id AS VARCHAR) AS key FROM measures WHERE superseded_by IS NULL AND pct_yes IS NOT NULL AND threshold_required IS NULL",
    "g20": "SELECT CAST(id AS VARCHAR) AS key FROM measures WHERE abs(margin_vs_threshold-(pct_yes-threshold_required))>0.05",
    "g21": "SELECT CAST(id AS VARCHAR) AS key FROM measures WHERE superseded_by IS NULL AND votes_total IS NULL AND pct_yes IS NULL",
    "g22": "SELECT DISTINCT j.state_usps AS key FROM facts t JOIN jurisdiction j ON j.geoid=t.geoid WHERE t.superseded_by IS NULL AND NOT EXISTS (SELECT 1 FROM grants g WHERE g.state_usps=j.state_usps)",
    "g23": "SELECT DISTINCT j.state_usps AS key FROM measures b JOIN jurisdiction j ON j.geoid=b.geoid WHERE b.superseded_by IS NULL AND NOT EXISTS (SELECT 1 FROM thresholds r WHERE r.state_usps=j.state_usps)",
    "g24": "SELECT DISTINCT b.geoid AS key FROM measures b WHERE NOT EXISTS (SELECT 1 FROM coverage_assertion k WHERE k.domain='ballot_measure' AND k.scope_geoid=b.geoid)",
    "g25": f"SELECT t.id AS key FROM {LIVE} AND t.extraction_method='agent_research' AND (t.source_quote IS NULL OR trim(t.source_quote)='')",
    "g26": r"SELECT t.id AS key FROM facts t JOIN archive_text a ON a.archive_file_id=t.archive_file_id WHERE t.superseded_by IS NULL AND trim(coalesce(t.source_quote,''))<>'' AND NOT contains(regexp_replace(a.text,'\s+',' ','g'), trim(regexp_replace(t.source_quote,'\s+',' ','g')))",
}
NAMES = {
    "g01": "no_source_url", "g02": "levied_no_rate", "g03": "rate_no_unit", "g04": "percent_range", "g05": "above_own_cap", "g06": "aggregator_only",
    "g07": "complete_without_findings", "g08": "framework_without_rules", "g09": "elections_without_measures", "g10": "stale", "g11": "expiration_unreadable",
    "g12": "passed_below_threshold", "g13": "share_off", "g14": "event_orphan", "g15": "weak_and_alone", "g16": "threshold_fraction", "g17": "rule_without_cite",
    "g18": "cap_no_unit", "g19": "result_no_threshold", "g20": "margin_off", "g21": "no_counts", "g22": "rates_no_caps", "g23": "measures_no_thresholds",
    "g24": "measured_uncovered", "g25": "research_no_quote", "g26": "quote_not_archived"}

for _g, _sql in ORACLES.items():
    query(f"{_g}_{NAMES[_g]}", _sql)(lambda t, g=_g: checks.run(t, [g]).select("key"))

ALL = " UNION ALL ".join(f"SELECT '{g}' AS check_id, key FROM ({sql}) x" for g, sql in ORACLES.items())
SQL["all_checks"] = ALL


@query("g27_check_summary", """SELECT check_id, count(*) AS n, string_agg(key, ', ' ORDER BY key) FILTER (WHERE rn<=8) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY key) AS rn FROM all_checks) x GROUP BY 1""")
def g27(t):
    return checks.summary(kept(checks.run(_stored(t)), "flagged"))


@query("g27_strict_verdict", "SELECT count(*) AS flagged, CASE WHEN count(*)>0 THEN 1 ELSE 0 END AS strict_failure FROM all_checks")
def g27b(t):
    return checks.verdict(checks.run(_stored(t)))


def _stored(t):
    """Facts, rate changes, measures and items feed many checks; facts and changes are cheap to make of the numbered history."""
    return t.store("numbered", "measures", "work")
