"""Queries: plausibility flags and verdict routing (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import loose
from ..functions.shared import cut
from ..operators import flags
from .derived import n_documents
from .fixtures import AS_OF, SQL
from .registry import query

c = F.col
null = lambda k: F.lit(None).cast(k)


def _loose(x): return f"trim(regexp_replace(lower(coalesce({x},'')),'[^a-z0-9.%$]+',' ','g'))"


STATE_NAMES = "(VALUES " + ",".join(f"('{a}','{u}')" for a, u in
                                    [(u.lower(), u) for _, u, _ in fixed.STATES if u != "VA"] + [(n.lower().replace(" ", ""), u) for _, u, n in fixed.STATES]) + ") AS h(second, usps)"


def _flag_list(label, pairs):
    cases = ", ".join(f"CASE WHEN {p} THEN '{code}{'!' if hard else ''}' END" for code, hard, p in pairs)
    return f"array_to_string(list_filter([{cases}], lambda e: e IS NOT NULL), ',')"


def _codes(df, keys):
    txt = F.transform("flags", lambda f: F.concat(f["code"], F.when(f["hard"], "!").otherwise("")))
    return df.select(*keys, F.array_join(txt, ",").alias("codes"))


SQL["displaced"] = """
SELECT t.*, p.prev_as_of FROM facts t LEFT JOIN (SELECT superseded_by, max(coalesce(effective_date, CAST(fiscal_year AS VARCHAR)||'-01-01')) AS prev_as_of FROM facts
 WHERE superseded_by IS NOT NULL AND superseded_by<>id GROUP BY 1) p ON p.superseded_by=t.id WHERE t.superseded_by IS NULL"""
SQL["own_rates"] = """SELECT j.state_usps AS own_state, f.category, max(f.rate_value) AS state_rate FROM facts f JOIN jurisdiction j ON j.geoid=f.geoid AND j.kind='state'
 WHERE f.superseded_by IS NULL AND f.rate_unit='percent' AND f.rate_value IS NOT NULL GROUP BY 1,2"""


@query("h4_displaced_date", "SELECT id, prev_as_of FROM displaced")
def h4(t):
    return flags.with_displaced_date(t.facts).select("id", "prev_as_of")


@query("h6_place_context", """SELECT t.id, j.state_usps AS own_state, j.kind, CASE WHEN j.kind<>'state' THEN r.state_rate END AS state_rate
FROM facts t LEFT JOIN jurisdiction j ON j.geoid=t.geoid LEFT JOIN own_rates r ON r.own_state=j.state_usps AND r.category=t.category""")
def h6(t):
    return flags.with_place_context(t.facts, t.jurisdiction, flags.state_rates(t.facts, t.jurisdiction)).select("id", "own_state", "kind", "state_rate")


SQL["cited"] = """SELECT id, CASE id%6 WHEN 0 THEN 'https://tax.oh.gov/a' WHEN 1 THEN 'https://www.northcarolina.gov/b?x=1' WHEN 2 THEN 'http://benefits.va.gov/c' WHEN 3 THEN 'https://virginia.gov' WHEN 4 THEN url ELSE NULL END AS link FROM source"""


@query("h7_host_state", f"""SELECT s.id, h.usps AS host_state FROM (SELECT id, CASE WHEN regexp_matches(lower(regexp_extract(link,'://([^/?#:]+)',1)), '(^|\\.)[^.]+\\.gov$')
  THEN regexp_extract(lower(regexp_extract(link,'://([^/?#:]+)',1)),'([^.]+)\\.gov$',1) END AS second FROM cited) s LEFT JOIN {STATE_NAMES} ON h.second=s.second""")
def h7(t):
    return flags.host_state(_cited(t), t.spark, "link").select("id", "host_state")


def _cited(t):
    k = c("id") % 6
    link = (F.when(k == 0, "https://tax.oh.gov/a").when(k == 1, "https://www.northcarolina.gov/b?x=1").when(k == 2, "http://benefits.va.gov/c")
            .when(k == 3, "https://virginia.gov").when(k == 4, c("url")))
    return t.source.select("id", link.alias("link"))


RANGE = " OR ".join(f"(rate_unit='{u}' AND (rate_value<{lo} OR rate_value>{hi}))" for u, (lo, hi) in fixed.PLAUSIBLE_RANGE.items())
QUOTE = "trim(coalesce(source_quote,''))"
SAID = _loose("coalesce(label,'')||' '||" + QUOTE)
RATE = [
    ("no_quote", 0, f"{QUOTE}='' AND extraction_method<>'bulk_import'"),
    ("quote_missing", 0, f"{QUOTE}<>'' AND coalesce(doc_norm,'')<>'' AND NOT contains(doc_norm, {_loose(QUOTE)})"),
    ("not_a_tax", 1, "(" + " OR ".join(f"contains({SAID}, '{w}')" for w in fixed.NOT_A_TAX_TERMS) + ")"),
    ("implausible_rate", 1, f"({RANGE})"), ("status_conflict", 1, "status='prohibited' AND rate_value IS NOT NULL"),
    ("over_cap", 1, "cap_unit IS NOT DISTINCT FROM rate_unit AND rate_value>cap_value"), ("low_confidence", 0, "confidence='low'"),
    ("cross_reference", 0, f"regexp_matches({QUOTE}, '(?i)(?:^|[\\n*•|(\\[]|[-—–])\\s*see\\s+\\S')"),
    ("combined_rate", 0, "category='sales_use' AND rate_unit='percent' AND rate_value>=state_rate"),
    ("wrong_state_source", 1, "extraction_method<>'bulk_import' AND kind<>'state' AND src_state<>upper(own_state)"),
    ("date_regression", 1, "prev_as_of IS NOT NULL AND (substr(effective_date,1,10)<substr(prev_as_of,1,10) OR (effective_date IS NULL AND fiscal_year<CAST(substr(prev_as_of,1,4) AS INT)))"),
    ("undated_supersede", 1, "prev_as_of IS NOT NULL AND effective_date IS NULL AND fiscal_year IS NULL")]

SQL["doc_norms"] = f"SELECT archive_file_id, {_loose('text')} AS doc_norm FROM archive_text"
SQL["rate_subject"] = f"""
SELECT d.id, d.geoid, d.category, d.instrument_code, d.label, CASE WHEN d.seq%8=0 THEN 'prohibited' ELSE d.status END AS status, d.rate_value, d.rate_unit, d.cap_value, d.cap_unit, d.confidence,
 CASE WHEN d.seq%9=0 THEN '* see New York City' ELSE d.source_quote END AS source_quote, d.extraction_method,
 CASE WHEN d.seq%7=0 THEN NULL WHEN d.seq%7=1 THEN '1990-01-01' ELSE d.effective_date END AS effective_date, CASE WHEN d.seq%14=0 THEN CAST(1994 AS BIGINT) END AS fiscal_year, d.prev_as_of,
 j.state_usps AS own_state, j.kind, CASE WHEN j.kind<>'state' THEN r.state_rate END AS state_rate, h.usps AS src_state, n.doc_norm, d.seq
FROM displaced d LEFT JOIN jurisdiction j ON j.geoid=d.geoid LEFT JOIN own_rates r ON r.own_state=j.state_usps AND r.category=d.category
LEFT JOIN cited k ON k.id=d.source_id LEFT JOIN {STATE_NAMES} ON h.second=CASE WHEN regexp_matches(lower(regexp_extract(k.link,'://([^/?#:]+)',1)), '(^|\\.)[^.]+\\.gov$') THEN regexp_extract(lower(regexp_extract(k.link,'://([^/?#:]+)',1)),'([^.]+)\\.gov$',1) END
LEFT JOIN doc_norms n ON n.archive_file_id=d.archive_file_id"""
SQL["rate_codes"] = f"SELECT id, geoid, category, {_flag_list('', RATE)} AS codes FROM rate_subject"


def rate_subject(t):
    s, t = c("seq"), t.store("numbered")   # facts are read by several steps
    d = flags.with_displaced_date(t.facts)
    d = flags.with_place_context(d, t.jurisdiction, flags.state_rates(t.facts, t.jurisdiction))
    links = flags.host_state(_cited(t), t.spark, "link", "src_state").select(c("id").alias("source_id"), "src_state")
    norms = t.archive_text.repartition("archive_file_id").select("archive_file_id", loose(c("text")).alias("doc_norm"))   # dealt first: texts may lie in one split
    return d.join(links, "source_id", "left").join(norms, "archive_file_id", "left").withColumn("status", F.when(s % 8 == 0, "prohibited").otherwise(c("status"))) \
        .withColumn("source_quote", F.when(s % 9 == 0, "* see New York City").otherwise(c("source_quote"))) \
        .withColumn("effective_date", F.when(s % 7 == 0, null("string")).when(s % 7 == 1, "1990-01-01").otherwise(c("effective_date"))) \
        .withColumn("fiscal_year", F.when(s % 14 == 0, F.lit(1994).cast("bigint")))


@query("h1_rate_flags", "SELECT id, codes FROM rate_codes")
def h1(t):
    return _codes(flags.rate_flags(rate_subject(t)), ["id"])


SQL["measure_doc"] = f"SELECT doc_id, {_loose('text')}||' issue 7 and issue 13 ' AS doc_norm FROM documents"
MEASURE = [("no_result", 1, "votes_total IS NULL AND pct_yes IS NULL"), ("no_threshold", 0, "threshold_required IS NULL"), ("outcome_unknown", 0, "outcome='unknown'"),
           ("low_confidence", 0, "confidence='low'"), ("weak_source", 0, "coalesce(authority_tier,4)>=4"),
           ("id_missing", 0, f"coalesce(doc_norm,'')<>'' AND measure_id_local<>'' AND NOT contains(doc_norm, {_loose('measure_id_local')})"),
           ("future_result", 1, f"election_date>'{AS_OF}' AND outcome IN ('passed','failed')")]
SQL["top_measures"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY election_date DESC, id DESC) AS rn FROM measures WHERE superseded_by IS NULL) x"


def _measure_subject(t):
    m = flags.newest_measures(t.measures).withColumn("_d", c("id") * 7919 % n_documents(t)) \
        .withColumn("outcome", F.when(c("id") % 6 == 0, "unknown").otherwise(c("outcome"))) \
        .withColumn("pct_yes", F.when(c("id") % 10 == 0, null("double")).otherwise(c("pct_yes"))) \
        .withColumn("votes_total", F.when(c("id") % 5 == 0, null("bigint")).otherwise(c("votes_total")))
    docs = t.documents.select(c("doc_id").alias("_d"), F.concat(loose(c("text")), F.lit(" issue 7 and issue 13 ")).alias("doc_norm"))
    return m.join(docs, "_d", "left")


@query("h2_measure_flags", f"""SELECT id, {_flag_list('', MEASURE)} AS codes FROM (SELECT m.* REPLACE (CASE WHEN id%6=0 THEN 'unknown' ELSE outcome END AS outcome, CASE WHEN id%10=0 THEN NULL ELSE pct_yes END AS pct_yes,
 CASE WHEN id%5=0 THEN NULL ELSE votes_total END AS votes_total), d.doc_norm FROM top_measures m LEFT JOIN measure_doc d ON d.doc_id=m.id*7919%(SELECT count(*) FROM documents)) x""")
def h2(t):
    return _codes(flags.measure_flags(_measure_subject(t), AS_OF), ["id"])


SQL["framework_rows"] = """
SELECT 'threshold' AS rule_kind, state_usps, id, measure_class AS label, threshold_value, NULL AS permitted, CAST(NULL AS DOUBLE) AS max_rate, statute_cite, confidence, authority_tier FROM (
 SELECT *, row_number() OVER (PARTITION BY state_usps ORDER BY id DESC) AS rn FROM thresholds) a
UNION ALL SELECT 'grant', state_usps, id, instrument_code, NULL, permitted, max_rate, statute_cite, confidence, authority_tier FROM (
 SELECT *, row_number() OVER (PARTITION BY state_usps ORDER BY id DESC) AS rn FROM grants) b"""
FRAMEWORK = [("threshold_scale", 1, "threshold_value<=1.0"), ("threshold_low", 0, "threshold_value>1.0 AND threshold_value<50.0"), ("no_cap", 0, "permitted='yes' AND max_rate IS NULL"),
             ("no_cite", 0, "coalesce(statute_cite,'')=''"), ("cite_missing", 0, f"statute_cite<>'' AND coalesce(doc_norm,'')<>'' AND NOT contains(doc_norm, {_loose('statute_cite')})"),
             ("low_confidence", 0, "confidence='low'"), ("weak_source", 0, "coalesce(authority_tier,4)>=4")]


@query("h3_framework_flags", f"""SELECT rule_kind, id, {_flag_list('', FRAMEWORK)} AS codes FROM (SELECT f.* REPLACE (CASE WHEN id%9=0 THEN threshold_value-12 ELSE threshold_value END AS threshold_value), CASE WHEN d.doc_norm<>'' THEN d.doc_norm||' code 5.1 ' END AS doc_norm FROM framework_rows f LEFT JOIN doc_norms d ON d.archive_file_id=(f.id*7919+CAST(f.state_usps AS BIGINT))%(SELECT count(*) FROM documents)) x""")
def h3(t):
    r = flags.newest_rules(t.thresholds, t.grants).withColumn("threshold_value", F.when(c("id") % 9 == 0, c("threshold_value") - 12).otherwise(c("threshold_value")))
    d = t.archive_text.select(c("archive_file_id").alias("_s"), F.concat(loose(c("text")), F.lit(" code 5.1 ")).alias("doc_norm"))
    return _codes(flags.framework_flags(r.withColumn("_s", (c("id") * 7919 + c("state_usps").cast("bigint")) % n_documents(t)).join(d, "_s", "left")), ["rule_kind", "id"])


@query("h5_newest_measures", "SELECT id, geoid, election_date FROM top_measures")
def h5(t):
    return flags.newest_measures(t.measures).select("id", "geoid", "election_date")


@query("h5_newest_rules", "SELECT rule_kind, id, state_usps, label FROM framework_rows")
def h5b(t):
    return flags.newest_rules(t.thresholds, t.grants).select("rule_kind", "id", "state_usps", "label")


@query("h8_subject_rows", """SELECT id FROM facts t WHERE superseded_by IS NULL AND (seq%3=0 OR NOT EXISTS (SELECT 1 FROM facts h WHERE h.superseded_by IS NULL AND h.seq%3=0 AND h.geoid=t.geoid AND h.category=t.category))""")
def h8(t):
    liv = t.facts.where(c("superseded_by").isNull())
    return flags.subject_rows(liv, liv.where(c("seq") % 3 == 0).select("id"), ["geoid", "category"]).select("id")


EXCERPT_CHARS, ANCHOR_CHARS = 8000, 160
_SEPARATOR = "'" + fixed.EXCERPT_SEPARATOR.replace("\n\n", "'||chr(10)||chr(10)||'") + "'"


@query("h9_excerpts", f"""WITH hit AS (SELECT doc_id, instr(text, a) AS p, length(a) AS l FROM (SELECT doc_id, text, unnest([trim(substr(text,5000,{ANCHOR_CHARS})), trim(substr(text,12000,40)), 'no such anchor text']) AS a FROM documents) x WHERE length(a)>=3 AND instr(text, a)>0),
spans AS (SELECT doc_id, CAST(0 AS BIGINT) AS s, least(3000, length(text)) AS e FROM documents UNION ALL SELECT h.doc_id, greatest(0, h.p-1-2000), least(length(d.text), h.p-1+h.l+2000) FROM hit h JOIN documents d USING (doc_id)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans) y),
merged AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, g), used AS (SELECT *, coalesce(sum(e-s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM merged),
cut AS (SELECT doc_id, string_agg(substr(d.text, CAST(s+1 AS BIGINT), CAST(least(e-s, {EXCERPT_CHARS}-before) AS BIGINT)), {_SEPARATOR} ORDER BY s) AS t FROM used JOIN documents d USING (doc_id) WHERE before<{EXCERPT_CHARS} GROUP BY doc_id),
shown AS (SELECT doc_id, CASE WHEN length(d.text)<={EXCERPT_CHARS} OR NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id=d.doc_id) THEN substr(d.text,1,{EXCERPT_CHARS}) ELSE c.t END AS t FROM documents d JOIN cut c USING (doc_id))
SELECT doc_id, md5(t) AS excerpt_md5, CAST(length(t) AS INT) AS n FROM shown""")
def h9(t):
    d = t.documents.select("doc_id", "text", F.array(F.substring("text", 5000, ANCHOR_CHARS), F.substring("text", 12000, 40), F.lit("no such anchor text")).alias("anchors"))
    return d.select("doc_id", flags.excerpt(c("text"), c("anchors"), EXCERPT_CHARS).alias("t")).select("doc_id", F.md5("t").alias("excerpt_md5"), F.length("t").alias("n"))


SQL["flag_counts"] = """SELECT geoid, category, count(*) AS n_rows, CAST(sum(length(codes)-length(replace(codes,'!',''))) AS BIGINT) AS n_hard,
 CAST(sum(CASE WHEN codes='' THEN 0 ELSE 1+length(codes)-length(replace(codes,',','')) END) AS BIGINT) AS n_all FROM rate_codes GROUP BY 1,2"""
SQL["ai_answers"] = """SELECT geoid, category, CASE WHEN seq%3=0 THEN 'Flag' WHEN seq%5=0 THEN NULL ELSE ' pass' END AS verdict FROM facts WHERE superseded_by IS NULL AND seq%4<>0"""


def _exploded(t):
    f = cut(flags.rate_flags(rate_subject(t)).select("geoid", "category", c("seq").alias("row_no"), "flags"))   # rows and their flags are both counted
    return f, flags.explode_flags(f, ["geoid", "category", "row_no"])


@query("h10_route", """SELECT f.geoid, f.category, f.n_rows, f.n_hard, f.n_all-f.n_hard AS n_soft,
 CASE WHEN f.n_hard>0 THEN 'flag' WHEN x.geoid IS NOT NULL OR coalesce(a.n,0)<f.n_rows THEN 'error' WHEN a.bad>0 THEN 'flag' ELSE 'pass' END AS verdict,
 CASE WHEN f.n_hard=0 AND x.geoid IS NULL AND coalesce(a.n,0)>=f.n_rows AND a.bad=0 THEN 'complete' ELSE 'needs_review' END AS status
FROM flag_counts f LEFT JOIN (SELECT geoid, category, count(*) AS n, count(*) FILTER (WHERE lower(trim(coalesce(verdict,'')))<>'pass') AS bad FROM ai_answers GROUP BY 1,2) a ON a.geoid=f.geoid AND a.category=f.category
LEFT JOIN (SELECT DISTINCT geoid, category FROM facts WHERE substr(geoid,2,1)='3') x ON x.geoid=f.geoid AND x.category=f.category""")
def h10(t):
    rows, fl = _exploded(t)
    items = rows.groupBy("geoid", "category").agg(F.count("*").alias("n_rows"))
    s = c("seq")
    ans = t.facts.where(c("superseded_by").isNull() & (s % 4 != 0)).select("geoid", "category", F.when(s % 3 == 0, "Flag").when(s % 5 == 0, null("string")).otherwise(" pass").alias("verdict"))
    fail = t.facts.where(F.substring("geoid", 2, 1) == "3").select("geoid", "category")
    return flags.route(items, fl, ans, fail).drop("summary")


@query("h11_advice", f"""SELECT geoid, category, code, lean, CASE lean WHEN 'publish' THEN 'complete' WHEN 'try_again' THEN 'pending' WHEN 'no_such_tax' THEN 'no_data' END AS suggested_status FROM (
 SELECT geoid, category, CASE WHEN l.lean IS NOT NULL THEN f.code END AS code, coalesce(l.lean,'unsure') AS lean, row_number() OVER (PARTITION BY geoid, category ORDER BY CASE WHEN l.lean IS NULL THEN 1 ELSE 0 END, seq, pos) AS rn
 FROM (SELECT geoid, category, seq, unnest(list_filter(string_split(codes,','), lambda z: z LIKE '%!')) AS raw, unnest(range(1, 1+len(list_filter(string_split(codes,','), lambda z: z LIKE '%!')))) AS pos
   FROM (SELECT k.*, s.seq FROM rate_codes k JOIN facts s ON s.id=k.id) q) u CROSS JOIN LATERAL (SELECT replace(u.raw,'!','') AS code) f
 LEFT JOIN (VALUES {','.join(f"('{k}','{v}')" for k, v in fixed.ADVICE_LEAN.items())}) AS l(code, lean) ON l.code=f.code) y WHERE rn=1""")
def h11(t):
    _, fl = _exploded(t)
    return flags.advise(fl, t.spark)
