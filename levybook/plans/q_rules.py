"""Queries: row validation (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import rules
from .fixtures import SQL, derived
from .registry import query

c = F.col
null = lambda k: F.lit(None).cast(k)


def _in(vals): return "(" + ",".join(f"'{v}'" for v in vals) + ")"
def _iso(x): return f"coalesce(regexp_matches({x},'^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND TRY_CAST(substr({x},6,2) AS INT) BETWEEN 1 AND 12 AND TRY_CAST(substr({x},9,2) AS INT) BETWEEN 1 AND 31 AND TRY_CAST(substr({x},1,4) AS INT)>=1800, FALSE)"
def _baddate(x): return f"coalesce({x},'')<>'' AND NOT {_iso(x)}"


def _errors(label, pairs):
    """Oracle text for an error list in rule order."""
    cases = ", ".join(f"CASE WHEN {p} THEN '{label}['||CAST(pos AS VARCHAR)||']: {code}' END" for code, p in pairs)
    return f"array_to_string(list_filter([{cases}], lambda e: e IS NOT NULL), '; ')"


def _shown(df, keys): return df.select(*keys, F.array_join("errors", "; ").alias("errors"))


SRC = [("no_source_url", "coalesce(source_url,'')=''"), ("bad_authority_tier", "authority_tier IS NOT NULL AND authority_tier NOT IN (1,2,3,4)")]
PAIR = [("unknown_category", f"category IS NULL OR category NOT IN {_in(fixed.TAX_CATEGORIES)}"),
        ("unknown_instrument", f"instrument_code IS NULL OR instrument_code NOT IN {_in(fixed.INSTRUMENTS)}"),
        ("instrument_not_in_category", f"instrument_code IN {_in(fixed.INSTRUMENTS)} AND category IN {_in(fixed.TAX_CATEGORIES)} AND NOT ("
         + " OR ".join(f"(category='{k}' AND instrument_code IN {_in(v)})" for k, v in fixed.INSTRUMENTS_BY_CATEGORY.items()) + ")")]
FINDING = PAIR + [
    ("unknown_status", f"status IS NULL OR status NOT IN {_in(fixed.STATUSES)}"), ("missing_geoid", "coalesce(geoid,'')=''"),
    ("unknown_rate_unit", f"rate_unit NOT IN {_in(fixed.RATE_UNITS)}"), ("unknown_cap_type", f"cap_type NOT IN {_in(fixed.CAP_TYPES)}"),
    ("unknown_confidence", f"confidence IS NULL OR confidence NOT IN {_in(fixed.CONFIDENCE)}"),
    ("bad_voter_approval", f"voter_approval_required NOT IN {_in(fixed.TERNARY)}"), *SRC,
    ("rate_without_unit", "rate_value IS NOT NULL AND coalesce(rate_unit,'')=''"),
    ("percent_out_of_range", "rate_unit='percent' AND (rate_value<0 OR rate_value>25)"),
    ("levied_without_rate", "status='levied' AND rate_value IS NULL AND coalesce(instrument_code,'') NOT IN ('assessment_ratio','homestead_exemption')"),
    ("expiration_not_iso", _baddate("expiration_date"))]


@derived("finding_rows", """
SELECT id, seq AS pos, CASE WHEN seq%37=0 THEN '' WHEN seq%41=0 THEN '9999999' ELSE geoid END AS geoid, CASE WHEN seq%19=0 THEN 'elections' WHEN seq%23=0 THEN 'income_payroll' ELSE category END AS category,
 CASE WHEN seq%29=0 THEN 'poll_tax' WHEN seq%31=0 THEN 'assessment_ratio' ELSE instrument_code END AS instrument_code, CASE WHEN seq%43=0 THEN 'maybe' ELSE status END AS status,
 CASE WHEN seq%16=0 THEN CAST(40 AS DOUBLE) ELSE rate_value END AS rate_value, CASE WHEN seq%21=0 THEN 'bps' ELSE rate_unit END AS rate_unit, CASE seq%12 WHEN 0 THEN 'odd' WHEN 1 THEN 'rate_cap' END AS cap_type,
 CASE WHEN seq%33=0 THEN NULL ELSE confidence END AS confidence, CASE seq%14 WHEN 0 THEN 'perhaps' WHEN 1 THEN 'yes' END AS voter_approval_required,
 CASE WHEN seq%27=0 THEN '' ELSE 'https://x.gov/'||CAST(source_id AS VARCHAR) END AS source_url, CASE seq%15 WHEN 0 THEN 7 WHEN 1 THEN 2 END AS authority_tier, expiration_date,
 CASE seq%10 WHEN 0 THEN 'rumour' WHEN 1 THEN 'portal' END AS source_type FROM facts""")
def finding_rows(t):
    s = c("seq")
    w = lambda m, v, other: F.when(s % m == 0, v).otherwise(other)
    return t.facts.select(
        "id", s.alias("pos"), F.when(s % 37 == 0, "").when(s % 41 == 0, "9999999").otherwise(c("geoid")).alias("geoid"),
        F.when(s % 19 == 0, "elections").when(s % 23 == 0, "income_payroll").otherwise(c("category")).alias("category"),
        F.when(s % 29 == 0, "poll_tax").when(s % 31 == 0, "assessment_ratio").otherwise(c("instrument_code")).alias("instrument_code"),
        w(43, "maybe", c("status")).alias("status"), w(16, F.lit(40.0), c("rate_value")).alias("rate_value"), w(21, "bps", c("rate_unit")).alias("rate_unit"),
        F.when(s % 12 == 0, "odd").when(s % 12 == 1, "rate_cap").alias("cap_type"), F.when(s % 33 != 0, c("confidence")).alias("confidence"),
        F.when(s % 14 == 0, "perhaps").when(s % 14 == 1, "yes").alias("voter_approval_required"),
        w(27, "", F.concat(F.lit("https://x.gov/"), c("source_id").cast("string"))).alias("source_url"),
        F.when(s % 15 == 0, 7).when(s % 15 == 1, 2).alias("authority_tier"), "expiration_date",
        F.when(s % 10 == 0, "rumour").when(s % 10 == 1, "portal").alias("source_type"))


@query("c1_finding_rules", f"SELECT id, {_errors('finding', FINDING)} AS errors FROM finding_rows")
def c1(t):
    return _shown(rules.check(t.finding_rows, rules.finding_rules(), "finding"), ["id"])


PCT = [(f"{f}_not_a_percentage", f"{f}<0 OR {f}>100") for f in ("pct_yes", "threshold_required", "turnout_pct")]
NEG = [(f"{f}_negative", f"{f}<0") for f in ("votes_yes", "votes_no", "votes_total", "registered_voters", "ballots_cast")]
IMPLIED = "CASE WHEN coalesce(votes_total, votes_yes+votes_no)>0 THEN 100.0::DOUBLE*votes_yes/coalesce(votes_total, votes_yes+votes_no) END"
MEASURE = [
    ("missing_geoid", "coalesce(geoid,'')=''"), ("missing_election_date", "coalesce(election_date,'')=''"), ("election_date_not_iso", _baddate("election_date")),
    ("unknown_measure_class", f"measure_class IS NULL OR measure_class NOT IN {_in(fixed.MEASURE_CLASSES)}"),
    ("unknown_outcome", f"outcome IS NULL OR outcome NOT IN {_in(fixed.OUTCOMES)}"),
    ("unknown_election_type", f"election_type NOT IN {_in(fixed.ELECTION_TYPES)}"), ("unknown_category", f"category NOT IN {_in(fixed.TAX_CATEGORIES)}"),
    ("unknown_instrument", f"instrument_code NOT IN {_in(fixed.INSTRUMENTS)}"), ("unknown_threshold_basis", f"threshold_basis NOT IN {_in(fixed.THRESHOLD_BASES)}"),
    ("unknown_confidence", f"confidence IS NULL OR confidence NOT IN {_in(fixed.CONFIDENCE)}"), *PCT, *NEG,
    ("votes_exceed_total", "votes_yes+votes_no>votes_total"), ("pct_yes_disagrees_with_votes", f"abs({IMPLIED}-pct_yes)>0.5"),
    ("passed_below_threshold", f"outcome='passed' AND coalesce(pct_yes, {IMPLIED})<threshold_required"), ("sunset_date_not_iso", _baddate("sunset_date")), *SRC]


@derived("measure_checks", """
SELECT id, id%100 AS pos, geoid, CASE WHEN id%47=0 THEN '11/05/1996' WHEN id%49=0 THEN NULL ELSE election_date END AS election_date, CASE WHEN id%59=0 THEN 'recall' ELSE measure_class END AS measure_class, outcome,
 CASE id%8 WHEN 0 THEN 'runoff' WHEN 1 THEN 'special' END AS election_type, CASE id%9 WHEN 0 THEN 'elections' END AS category, instrument_code, threshold_basis, confidence, CASE WHEN id%61=0 THEN CAST(140 AS DOUBLE) ELSE pct_yes END AS pct_yes,
 threshold_required, turnout_pct, CASE WHEN id%67=0 THEN -votes_yes ELSE votes_yes END AS votes_yes, CASE WHEN id%7=0 THEN votes_total ELSE votes_no END AS votes_no, votes_total, registered_voters, ballots_cast,
 CASE id%10 WHEN 0 THEN 'someday' WHEN 1 THEN '2030-01-01' END AS sunset_date, CASE WHEN id%12<>0 THEN 'u' END AS source_url, CASE id%11 WHEN 0 THEN 9 WHEN 1 THEN 1 END AS authority_tier FROM measures""")
def measure_checks(t):
    i = c("id")
    return t.measures.select(
        i, (i % 100).alias("pos"), "geoid", F.when(i % 47 == 0, "11/05/1996").when(i % 49 != 0, c("election_date")).alias("election_date"),
        F.when(i % 59 == 0, "recall").otherwise(c("measure_class")).alias("measure_class"), "outcome", F.when(i % 8 == 0, "runoff").when(i % 8 == 1, "special").alias("election_type"),
        F.when(i % 9 == 0, "elections").alias("category"), "instrument_code", "threshold_basis", "confidence", F.when(i % 61 == 0, F.lit(140.0)).otherwise(c("pct_yes")).alias("pct_yes"),
        "threshold_required", "turnout_pct", F.when(i % 67 == 0, -c("votes_yes")).otherwise(c("votes_yes")).alias("votes_yes"), F.when(i % 7 == 0, c("votes_total")).otherwise(c("votes_no")).alias("votes_no"),
        "votes_total", "registered_voters", "ballots_cast", F.when(i % 10 == 0, "someday").when(i % 10 == 1, "2030-01-01").alias("sunset_date"), F.when(i % 12 != 0, "u").alias("source_url"),
        F.when(i % 11 == 0, 9).when(i % 11 == 1, 1).alias("authority_tier"))


@query("c2_measure_rules", f"SELECT id, {_errors('measure', MEASURE)} AS errors FROM measure_checks")
def c2(t):
    return _shown(rules.check(t.measure_checks, rules.measure_rules(), "measure"), ["id"])


STATE = ("bad_state_code", "state_usps IS NULL OR length(trim(state_usps))<>2")
KINDR = ("unknown_kind", f"jurisdiction_kind NOT IN {_in(fixed.KINDS)}")
TAIL = [("missing_cite", "coalesce(statute_cite,'')=''"), ("unknown_confidence", f"confidence IS NULL OR confidence NOT IN {_in(fixed.CONFIDENCE)}"),
        ("effective_from_not_iso", _baddate("effective_from")), ("effective_to_not_iso", _baddate("effective_to")), *SRC]
THRESHOLD = [STATE, KINDR, ("unknown_measure_class", f"measure_class IS NULL OR measure_class NOT IN {_in(fixed.MEASURE_CLASSES)}"),
             ("unknown_instrument", f"instrument_code NOT IN {_in(fixed.INSTRUMENTS)}"), ("unknown_purpose", "purpose_restriction NOT IN ('general','special','either')"),
             ("missing_threshold_value", "threshold_value IS NULL"), ("threshold_not_a_percentage", "threshold_value<0 OR threshold_value>100"),
             ("threshold_is_a_fraction", "threshold_value>=0 AND threshold_value<=1.0"), ("unknown_threshold_basis", f"threshold_basis IS NULL OR threshold_basis NOT IN {_in(fixed.THRESHOLD_BASES)}"),
             *[(f"bad_{f}", f"{f} NOT IN {_in(fixed.TERNARY)}") for f in ("sunset_required", "reimposition_allowed", "petition_alternative")],
             ("sunset_max_years_negative", "sunset_max_years<0"), ("cooling_off_months_negative", "cooling_off_months<0"), *TAIL]


@derived("threshold_checks", """
SELECT id, id%50 AS pos, CASE WHEN id%15=0 THEN 'OHIO' ELSE state_usps END AS state_usps, CASE WHEN id%16=0 THEN 'borough' ELSE jurisdiction_kind END AS jurisdiction_kind, CASE WHEN id%17=0 THEN NULL ELSE measure_class END AS measure_class, instrument_code,
 CASE WHEN id%18=0 THEN 'capital' ELSE purpose_restriction END AS purpose_restriction, CASE WHEN id%19=0 THEN NULL WHEN id%20=0 THEN CAST(120 AS DOUBLE) ELSE threshold_value END AS threshold_value, CASE WHEN id%21=0 THEN 'coin_toss' ELSE threshold_basis END AS threshold_basis,
 CASE id%6 WHEN 0 THEN 'never' WHEN 1 THEN 'no' END AS sunset_required, CAST(NULL AS VARCHAR) AS reimposition_allowed, CASE id%7 WHEN 0 THEN 'si' END AS petition_alternative, CAST(id%9-1 AS DOUBLE) AS sunset_max_years, id%10-1 AS cooling_off_months, statute_cite, confidence,
 CASE WHEN id%8=0 THEN '1/1/1990' ELSE effective_from END AS effective_from, effective_to, CASE WHEN id%12<>0 THEN 'u' END AS source_url, authority_tier FROM thresholds""")
def threshold_checks(t):
    i = c("id")
    w = lambda m, v, col: F.when(i % m == 0, v).otherwise(c(col)).alias(col)
    return t.thresholds.select(
        i, (i % 50).alias("pos"), w(15, "OHIO", "state_usps"), w(16, "borough", "jurisdiction_kind"), F.when(i % 17 != 0, c("measure_class")).alias("measure_class"), "instrument_code",
        w(18, "capital", "purpose_restriction"), F.when(i % 19 == 0, null("double")).when(i % 20 == 0, F.lit(120.0)).otherwise(c("threshold_value")).alias("threshold_value"), w(21, "coin_toss", "threshold_basis"),
        F.when(i % 6 == 0, "never").when(i % 6 == 1, "no").alias("sunset_required"), null("string").alias("reimposition_allowed"), F.when(i % 7 == 0, "si").alias("petition_alternative"),
        (i % 9 - 1).cast("double").alias("sunset_max_years"), (i % 10 - 1).alias("cooling_off_months"), "statute_cite", "confidence", w(8, "1/1/1990", "effective_from"), "effective_to",
        F.when(i % 12 != 0, "u").alias("source_url"), "authority_tier")


@query("c3_threshold_rules", f"SELECT id, {_errors('threshold', THRESHOLD)} AS errors FROM threshold_checks")
def c3(t):
    return _shown(rules.check(t.threshold_checks, rules.threshold_rules(), "threshold"), ["id"])


GRANT = [STATE, KINDR, *PAIR, ("bad_permitted", "permitted IS NULL OR permitted NOT IN ('yes','no','conditional')"), ("rate_without_unit", "max_rate IS NOT NULL AND coalesce(max_rate_unit,'')=''"),
         ("unknown_rate_unit", f"max_rate_unit NOT IN {_in(fixed.RATE_UNITS)}"), ("percent_out_of_range", "max_rate_unit='percent' AND (max_rate<0 OR max_rate>25)"),
         ("barred_with_rate", "permitted='no' AND max_rate IS NOT NULL"), *TAIL]


@derived("grant_checks", """
SELECT id, id%50 AS pos, state_usps, jurisdiction_kind, CASE WHEN id%14=0 THEN 'property' ELSE category END AS category, CASE WHEN id%22=0 THEN NULL ELSE instrument_code END AS instrument_code, CASE WHEN id%24=0 THEN 'maybe' ELSE permitted END AS permitted,
 CASE WHEN id%26=0 THEN max_rate*10 ELSE max_rate END AS max_rate, CASE WHEN id%28=0 THEN 'bps' ELSE max_rate_unit END AS max_rate_unit, statute_cite, confidence, effective_from, CASE WHEN id%9=0 THEN '1999-13-01' ELSE effective_to END AS effective_to,
 CASE WHEN id%12<>0 THEN 'u' END AS source_url, authority_tier FROM grants""")
def grant_checks(t):
    i = c("id")
    w = lambda m, v, col: F.when(i % m == 0, v).otherwise(c(col)).alias(col)
    return t.grants.select(i, (i % 50).alias("pos"), "state_usps", "jurisdiction_kind", w(14, "property", "category"), F.when(i % 22 != 0, c("instrument_code")).alias("instrument_code"),
                           w(24, "maybe", "permitted"), w(26, c("max_rate") * 10, "max_rate"), w(28, "bps", "max_rate_unit"), "statute_cite", "confidence", "effective_from",
                           w(9, "1999-13-01", "effective_to"), F.when(i % 12 != 0, "u").alias("source_url"), "authority_tier")


@query("c4_grant_rules", f"SELECT id, {_errors('grant', GRANT)} AS errors FROM grant_checks")
def c4(t):
    return _shown(rules.check(t.grant_checks, rules.grant_rules(), "grant"), ["id"])


@query("c5_profile_rules", f"""SELECT n_nationkey AS pos, array_to_string(list_filter([
 CASE WHEN n_nationkey%4=0 THEN 'profile['||CAST(n_nationkey AS VARCHAR)||']: bad_state_code' END,
 CASE WHEN (CASE WHEN n_nationkey%3=0 THEN 'no such doctrine' ELSE 'dillon' END) NOT IN {_in(fixed.HOME_RULE)} THEN 'profile['||CAST(n_nationkey AS VARCHAR)||']: bad_home_rule_doctrine' END,
 CASE WHEN n_nationkey*2>25 THEN 'profile['||CAST(n_nationkey AS VARCHAR)||']: local_sales_tax_max_out_of_range' END,
 CASE WHEN n_nationkey%5=0 THEN 'profile['||CAST(n_nationkey AS VARCHAR)||']: unknown_fields mayor' END], lambda e: e IS NOT NULL), '; ') AS errors FROM nation""")
def c5(t):
    k = c("n_nationkey")
    p = t.nation.select(k.alias("pos"), F.create_map(
        F.lit("state_usps"), F.when(k % 4 == 0, "OHIO").otherwise("OH"), F.lit("home_rule_doctrine"), F.when(k % 3 == 0, "no such doctrine").otherwise("dillon"),
        F.lit("local_sales_tax_max"), (k * 2).cast("string"), F.when(k % 5 == 0, "mayor").otherwise("notes"), c("n_name")).alias("profile"))
    return _shown(rules.check_profiles(p), ["pos"])


@query("c6_iso_shape", f"SELECT id, {_iso('expiration_date')} AS iso_shaped FROM facts")
def c6(t):
    return rules.iso_date_flag(t.facts, "expiration_date").select("id", "iso_shaped")


CONTEXT = [("geoid_not_seeded", "geoid<>'' AND geoid NOT IN (SELECT geoid FROM jurisdiction)"), ("unknown_source_type", f"source_type<>'' AND source_type NOT IN {_in(fixed.SOURCE_TYPES)}")]


@query("c7_context_rules", f"SELECT id, {_errors('finding', CONTEXT)} AS errors FROM finding_rows")
def c7(t):
    return _shown(rules.context_errors(t.finding_rows, t.jurisdiction, "finding"), ["id"])


def _n(pairs): return " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for _, p in pairs)


SQL["sections"] = f"""SELECT 'findings' AS section, {_n(FINDING + CONTEXT)} AS n FROM finding_rows UNION ALL SELECT 'measures', {_n(MEASURE)} FROM measure_checks
 UNION ALL SELECT 'thresholds', {_n(THRESHOLD)} FROM threshold_checks UNION ALL SELECT 'grants', {_n(GRANT)} FROM grant_checks"""


def _sections(t):
    f = rules.context_errors(rules.check(t.finding_rows, rules.finding_rules(), "finding"), t.jurisdiction, "finding")
    return {"findings": f, "measures": rules.check(t.measure_checks, rules.measure_rules(), "measure"),
            "thresholds": rules.check(t.threshold_checks, rules.threshold_rules(), "threshold"), "grants": rules.check(t.grant_checks, rules.grant_rules(), "grant")}


REPORT = "SELECT section, count(*) FILTER (WHERE n=0) AS valid, CAST(sum(n) AS BIGINT) AS rejected, {} AS written FROM sections GROUP BY 1"


@query("c8_load_partial", REPORT.format("count(*) FILTER (WHERE n=0)"))
def c8(t):
    return rules.load_report(_sections(t))


@query("c8_load_strict", REPORT.format("CAST(0 AS BIGINT)"))
def c8b(t):
    r = rules.load_report(_sections(t), strict=True)
    return r.withColumn("written", c("written").cast("bigint"))


@query("c9_stamp_defaults", """SELECT id, coalesce(CASE WHEN seq%5=0 THEN NULL ELSE category END, CASE WHEN seq%2=0 THEN 'property' END) AS category,
 coalesce(CASE WHEN seq%7=0 THEN NULL ELSE extraction_method END, 'agent_research') AS extraction_method, 'reader' AS researcher FROM facts""")
def c9(t):
    f = t.facts.select("id", F.when(c("seq") % 5 != 0, c("category")).alias("category"), F.when(c("seq") % 7 != 0, c("extraction_method")).alias("extraction_method"), "seq")
    item = F.when(c("seq") % 2 == 0, "property").otherwise("elections")
    return rules.stamp(f, "findings", category=item, researcher=F.lit("reader")).select("id", "category", "extraction_method", "researcher")


@query("c10_parse_responses", """SELECT event_id, CASE WHEN event_id%9=0 THEN 'empty_response' WHEN event_id%9=1 THEN 'unterminated_think' WHEN event_id%9=2 THEN 'not_json' WHEN event_id%9=3 THEN 'no_section'
 WHEN event_id%9=4 THEN 'section_not_an_array' END AS error, CASE WHEN event_id%9>=5 THEN 'g'||CAST(user_id AS VARCHAR) END AS first_geoid FROM events""")
def c10(t):
    e = c("event_id") % 9
    body = F.concat(F.lit('{"findings":[{"geoid":"g'), c("user_id").cast("string"), F.lit('"}]}'))
    raw = (F.when(e == 0, null("string")).when(e == 1, F.concat(F.lit("<think>hm {"), body)).when(e == 2, "sorry, nothing").when(e == 3, '{"note": 1}')
           .when(e == 4, '{"findings": {"a": 1}}').when(e == 5, body).when(e == 6, F.concat(F.lit("<think>a {b}</think> Here: "), body, F.lit(" done")))
           .when(e == 7, F.concat(F.lit("text\n```json\n"), body, F.lit("\n```\nbye }"))).otherwise(F.concat(F.lit("```"), body, F.lit("```"))))
    df = rules.parse_responses(t.events.select("event_id", "user_id", raw.alias("raw_response")), "findings array<struct<geoid:string>>, measures array<string>")
    return df.select("event_id", "error", c("doc.findings")[0]["geoid"].alias("first_geoid"))
