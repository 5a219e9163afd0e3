"""Queries: place registry and key resolution (B), sources and archive (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import place_key
from ..operators import spine
from ..sources import archive, files
from .fixtures import SQL, derived
from .registry import query

c = F.col
null = lambda k: F.lit(None).cast(k)


@derived("gaz", """
SELECT CASE WHEN kind='place' AND TRY_CAST(substr(geoid,3) AS BIGINT)%11=0 THEN 'mcd' ELSE kind END AS kind, geoid,
 CASE WHEN state_usps='05' THEN 'VA' ELSE state_usps END AS usps,
 CASE WHEN kind='county' AND TRY_CAST(substr(geoid,3) AS BIGINT)%2=0 THEN replace(name,'County','city') ELSE name END AS name,
 CASE WHEN kind='county' THEN '' WHEN TRY_CAST(substr(geoid,3) AS BIGINT)%7=0 THEN 'S' ELSE 'A' END AS funcstat FROM jurisdiction WHERE kind<>'state'""")
def gaz(t):
    n = F.substring("geoid", 3, 10).try_cast("bigint")
    return t.jurisdiction.where(c("kind") != "state").select(
        F.when((c("kind") == "place") & (n % 11 == 0), "mcd").otherwise(c("kind")).alias("kind"), "geoid",
        F.when(c("state_usps") == "05", "VA").otherwise(c("state_usps")).alias("usps"),
        F.when((c("kind") == "county") & (n % 2 == 0), F.replace("name", F.lit("County"), F.lit("city"))).otherwise(c("name")).alias("name"),
        F.when(c("kind") == "county", "").when(n % 7 == 0, "S").otherwise("A").alias("funcstat"))


SQL["built"] = """
SELECT g.geoid, g.kind, g.name, g.usps AS state_usps, substr(g.geoid,1,2) AS state_fips,
 CASE g.kind WHEN 'county' THEN g.geoid WHEN 'mcd' THEN substr(g.geoid,1,5) END AS county_fips,
 CASE WHEN g.kind='mcd' THEN substr(g.geoid,1,5) ELSE substr(g.geoid,1,2) END AS parent_geoid,
 CASE WHEN g.funcstat<>'' THEN g.funcstat WHEN g.kind='county' THEN 'A' END AS funcstat, p.population,
 CASE WHEN g.kind='county' AND g.usps='VA' AND lower(g.name) LIKE '%city%' THEN 1 ELSE 0 END AS coterminous
FROM gaz g LEFT JOIN jurisdiction p ON p.geoid=g.geoid WHERE g.kind='county' OR g.funcstat='A'"""


def _built(t):
    return spine.build_places(t.gaz, t.jurisdiction.where(c("population").isNotNull()).select("geoid", "population"))


@query("b1_build_places", "SELECT * FROM built")
def b1(t):
    return _built(t)


@query("b2_upsert_places", """SELECT coalesce(e.geoid, f.geoid) AS geoid, CASE WHEN f.geoid IS NOT NULL THEN f.name ELSE e.name END AS name,
 CASE WHEN f.geoid IS NOT NULL THEN f.population ELSE e.population END AS population, e.notes
FROM (SELECT geoid, upper(name) AS name, CAST(1 AS BIGINT) AS population, 'note '||geoid AS notes FROM jurisdiction WHERE CAST(substr(geoid,1,2) AS INT)%2=0) e
FULL OUTER JOIN built f ON f.geoid=e.geoid""")
def b2(t):
    old = t.jurisdiction.where(F.substring("geoid", 1, 2).cast("int") % 2 == 0).select(
        "geoid", F.upper("name").alias("name"), F.lit(1).cast("bigint").alias("population"), F.concat(F.lit("note "), c("geoid")).alias("notes"))
    return spine.upsert_places(old, _built(t).select("geoid", "name", "population"), ["notes"])


def _states(t):
    return t.jurisdiction.where(c("kind") == "state").select(c("geoid").alias("fips"), c("state_usps").alias("usps"), c("name").alias("state_name"))


@query("b3_state_rows", """SELECT j.geoid, 'state' AS kind, j.name, j.state_usps, j.geoid AS state_fips, 'A' AS funcstat, p.pop AS population
FROM jurisdiction j LEFT JOIN (SELECT state_usps, CAST(sum(population) AS BIGINT) AS pop FROM jurisdiction WHERE kind='county' GROUP BY 1) p ON p.state_usps=j.geoid WHERE j.kind='state'""")
def b3(t):
    pops = t.jurisdiction.where(c("kind") == "county").groupBy(c("state_usps").alias("geoid")).agg(F.sum("population").alias("population"))
    return spine.state_rows(_states(t), pops)


@query("b3_profile_stubs", "SELECT j.state_usps, j.name AS state_name FROM jurisdiction j WHERE j.kind='state' AND NOT EXISTS (SELECT 1 FROM state_profile p WHERE p.state_usps=j.state_usps)")
def b3b(t):
    return spine.profile_stubs(t.state_profile, _states(t))


CROSS = "(VALUES " + ",".join(f"('{f}','{n}','{u}')" for f, n, u, _ in fixed.CENSUS_STATES) + ") AS x(fips_state, census_state, usps)"


@query("b4_state_crosswalk", f"""SELECT k.c_custkey, x.fips_state FROM (SELECT c_custkey, CAST(c_custkey%60 AS VARCHAR) AS code FROM customer) k
LEFT JOIN {CROSS} ON x.census_state=lpad(k.code,2,'0')""")
def b4(t):
    return spine.census_to_fips(t.customer.select("c_custkey", (c("c_custkey") % 60).cast("string").alias("code")), t.spark, "code").drop("code")


FIPS = "(VALUES " + ",".join(f"('{f}','{u}')" for f, u, _ in fixed.STATES) + ") AS x(fips, usps)"


@query("b4_geoid_state", f"SELECT j.geoid, x.usps AS geoid_usps FROM jurisdiction j LEFT JOIN {FIPS} ON x.fips=substr(j.geoid,1,2)")
def b4b(t):
    return spine.geoid_state(t.jurisdiction.select("geoid"), t.spark)


@derived("fin_records", """
SELECT lpad(CAST(o_custkey AS VARCHAR),12,'0') AS unit_id, lpad(CAST(1+o_custkey%53 AS VARCHAR),2,'0') AS id_state, CAST(o_custkey%4 AS VARCHAR) AS unit_type, o_orderkey AS line_no FROM orders""")
def fin_records(t):
    k = c("o_custkey")
    return t.orders.select(F.lpad(k.cast("string"), 12, "0").alias("unit_id"), F.lpad((1 + k % 53).cast("string"), 2, "0").alias("id_state"),
                           (k % 4).cast("string").alias("unit_type"), c("o_orderkey").alias("line_no"))


@derived("fin_directory", """
SELECT lpad(CAST(c_custkey AS VARCHAR),12,'0') AS unit_id, 'SUPPLIER#'||lpad(CAST(c_custkey%100 AS VARCHAR),9,'0')||' county' AS name,
 CASE WHEN c_custkey%5=0 THEN '99001' WHEN c_custkey%7=0 THEN '12' ELSE lpad(CAST(c_custkey AS VARCHAR),5,'0') END AS place_code FROM customer""")
def fin_directory(t):
    k = c("c_custkey")
    return t.customer.select(F.lpad(k.cast("string"), 12, "0").alias("unit_id"),
                             F.concat(F.lit("SUPPLIER#"), F.lpad((k % 100).cast("string"), 9, "0"), F.lit(" county")).alias("name"),
                             F.when(k % 5 == 0, "99001").when(k % 7 == 0, "12").otherwise(F.lpad(k.cast("string"), 5, "0")).alias("place_code"))


@query("b6_finance_geoid", f"""SELECT r.line_no, r.unit_type, x.fips_state, CASE r.unit_type WHEN '0' THEN x.fips_state WHEN '1' THEN k.geoid
  WHEN '2' THEN CASE WHEN length(d.place_code)=5 AND d.place_code NOT LIKE '99%' THEN x.fips_state||d.place_code END END AS geoid
FROM fin_records r LEFT JOIN {CROSS} ON x.census_state=r.id_state LEFT JOIN fin_directory d ON d.unit_id=r.unit_id
LEFT JOIN (SELECT substr(geoid,1,2) AS st, regexp_replace(lower(name),'[^a-z0-9]','','g') AS nm, max(geoid) AS geoid FROM jurisdiction WHERE kind='county' GROUP BY 1,2) k
 ON k.st=x.fips_state AND k.nm=regexp_replace(lower(d.name),'[^a-z0-9]','','g')""")
def b6(t):
    return spine.finance_geoid(t.fin_records, t.fin_directory, t.jurisdiction, t.spark).select("line_no", "unit_type", "fips_state", "geoid")


@derived("odd_names", """
SELECT geoid, state_usps, kind, CASE CAST(substr(geoid,1,2) AS INT)%5 WHEN 0 THEN 'St. Foo & '||name||' city and borough' WHEN 1 THEN '  '||name||' charter township'
 WHEN 2 THEN 'Town '||CAST(TRY_CAST(substr(geoid,3) AS BIGINT)%50 AS VARCHAR)||' city' WHEN 3 THEN replace(name,'#','''')||' CDP' ELSE name END AS name FROM jurisdiction WHERE kind<>'state'""")
def odd_names(t):
    s = F.substring("geoid", 1, 2).cast("int") % 5
    n = (F.substring("geoid", 3, 10).try_cast("bigint") % 50).cast("string")
    nm = (F.when(s == 0, F.concat(F.lit("St. Foo & "), c("name"), F.lit(" city and borough"))).when(s == 1, F.concat(F.lit("  "), c("name"), F.lit(" charter township")))
          .when(s == 2, F.concat(F.lit("Town "), n, F.lit(" city"))).when(s == 3, F.concat(F.replace("name", F.lit("#"), F.lit("'")), F.lit(" CDP"))).otherwise(c("name")))
    return t.jurisdiction.where(c("kind") != "state").select("geoid", "state_usps", "kind", nm.alias("name"))


def _duck_key(x):
    tail = r"(?i)\s+(" + "|".join(sorted(fixed.CIVIC_SUFFIXES, key=len, reverse=True)) + ")$"
    for _ in range(3):
        x = f"trim(regexp_replace(trim({x}), '{tail}', ''))"
    x = f"replace(replace(upper({x}),'&','AND'),'.','')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '\\bST\\b', 'SAINT', 'g'), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


SQL["keyed_names"] = f"SELECT *, {_duck_key('name')} AS name_key FROM odd_names"


@query("b7_place_key", "SELECT geoid, name_key FROM keyed_names")
def b7(t):
    return t.odd_names.select("geoid", place_key(c("name")).alias("name_key"))


@query("b8_resolve_names", """SELECT a.ask_id, a.name_key, CASE WHEN l.n=1 THEN l.hit END AS geoid, CASE WHEN l.n IS NULL THEN 'unknown' WHEN l.n>1 THEN 'ambiguous:'||CAST(l.n AS VARCHAR) END AS reason
FROM (SELECT geoid AS ask_id, CASE WHEN CAST(substr(geoid,1,2) AS INT)%2=0 THEN state_usps ELSE '01' END AS state_usps, kind, name_key FROM keyed_names) a
LEFT JOIN (SELECT state_usps, kind, name_key, count(*) AS n, min(geoid) AS hit FROM keyed_names GROUP BY 1,2,3) l ON l.state_usps=a.state_usps AND l.kind=a.kind AND l.name_key=a.name_key""")
def b8(t):
    asked = t.odd_names.select(c("geoid").alias("ask_id"), F.when(F.substring("geoid", 1, 2).cast("int") % 2 == 0, c("state_usps")).otherwise("01").alias("state_usps"), "kind", "name")
    return spine.resolve_names(asked, t.odd_names).select("ask_id", "name_key", "geoid", "reason")


@query("b9_find_places", "SELECT geoid, name, state_usps, kind, population FROM jurisdiction WHERE name ILIKE '%0001%' OR geoid='0001' OR state_usps='0001' ORDER BY population DESC NULLS LAST, geoid LIMIT 30")
def b9(t):
    return spine.find_places(t.jurisdiction, "0001")


@query("b10_source_changes", """SELECT id, url, http_status, CASE WHEN http_status BETWEEN 200 AND 399 OR http_status IN (401,403,405) THEN 1 ELSE 0 END AS verified,
 coalesce(CASE WHEN http_status BETWEEN 200 AND 399 THEN sha END, stored) AS content_sha256,
 CASE WHEN http_status BETWEEN 200 AND 399 AND sha<>stored THEN 1 ELSE 0 END AS content_changed
FROM (SELECT id, url, CASE WHEN id%3=0 THEN NULL ELSE md5(name) END AS stored, CASE id%5 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN NULL ELSE 200 END AS http_status,
  CASE WHEN id%7=0 THEN NULL WHEN id%2=0 THEN md5(name) ELSE md5(url) END AS sha FROM source) x""")
def b10(t):
    i = c("id")
    st = t.source.withColumn("content_sha256", F.when(i % 3 != 0, F.md5("name")))
    fetched = t.source.select(i.alias("source_id"), F.when(i % 5 == 0, 404).when(i % 5 == 1, 403).when(i % 5 != 2, 200).alias("http_status"),
                              F.when(i % 7 == 0, null("string")).when(i % 2 == 0, F.md5("name")).otherwise(F.md5("url")).alias("body_sha"))
    return spine.source_changes(st, fetched)


@query("b11_merge_sources", """SELECT url, scope_geoid, arg_min(name, seq) AS name, arg_min(source_type, seq) AS source_type, arg_min(authority_tier, seq) AS authority_tier,
 arg_max(categories, seq) FILTER (WHERE coalesce(categories,'')<>'') AS categories
FROM (SELECT url, CASE WHEN id%4=1 THEN NULL ELSE scope_geoid END AS scope_geoid, name, source_type, authority_tier, categories, id AS seq FROM source
 UNION ALL SELECT url, CASE WHEN id%4=1 THEN NULL ELSE scope_geoid END, name||'x', 'portal', 4, CASE WHEN id%2=0 THEN 'income_payroll' END, id+1000000000 FROM source) u GROUP BY 1,2""")
def b11(t):
    i = c("id")
    scope = F.when(i % 4 != 1, c("scope_geoid")).alias("scope_geoid")
    old = t.source.select("url", scope, "name", "source_type", "authority_tier", "categories", i.alias("seq"))
    new = t.source.select("url", scope, F.concat("name", F.lit("x")).alias("name"), F.lit("portal").alias("source_type"), F.lit(4).alias("authority_tier"),
                          F.when(i % 2 == 0, "income_payroll").alias("categories"), (i + 1000000000).alias("seq"))
    return spine.merge_sources(old, new)


@query("b12_adopt_sources", """SELECT s.id, s.url, CASE WHEN s.scope_geoid IS NOT NULL THEN s.scope_geoid WHEN EXISTS (SELECT 1 FROM loose h WHERE h.url=s.url AND h.scope_geoid=k.scope_geoid) THEN NULL ELSE k.scope_geoid END AS scope_geoid
FROM loose s LEFT JOIN (SELECT url, min(scope_geoid) AS scope_geoid FROM source GROUP BY 1) k ON k.url=s.url""")
def b12(t):
    loose = t.source.select("id", "url", F.when(c("id") % 3 != 0, c("scope_geoid")).alias("scope_geoid"))
    return spine.adopt_sources(loose, t.source.groupBy("url").agg(F.min("scope_geoid").alias("scope_geoid")))


SQL["loose"] = "SELECT id, url, CASE WHEN id%3<>0 THEN scope_geoid END AS scope_geoid FROM source"


@query("b13_source_tier", f"""SELECT id, CASE WHEN st IN ('statute','ordinance') THEN 1 WHEN st='secondary' THEN 3
 WHEN regexp_matches(host, '{fixed.STATUTE_HOST_PATTERN}') OR regexp_matches(lower(url), '{fixed.STATUTE_PATH_PATTERN}') THEN 1
 WHEN host LIKE '%.gov' OR host LIKE '%.us' OR host LIKE '%.gov.%' THEN 2 WHEN host LIKE '%.org' OR host LIKE '%.edu' THEN 3 ELSE 4 END AS tier
FROM (SELECT id, url, CASE WHEN id%3=0 THEN source_type END AS st, lower(regexp_extract(url,'://([^/?#:]+)',1)) AS host FROM source) x""")
def b13(t):
    s = t.source.withColumn("st", F.when(c("id") % 3 == 0, c("source_type")))
    return s.select("id", spine.source_tier(c("url"), c("st")).alias("tier"))


# -- A ----------------------------------------------------------------------

@query("a3_latest_rate_files", """SELECT state, period, filename FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY period DESC, pos DESC) AS rn
 FROM (SELECT pos, filename, upper(regexp_extract(filename,'(?i)([A-Z]{2})R(\\d{4}Q[1-4])',1)) AS state, upper(regexp_extract(filename,'(?i)([A-Z]{2})R(\\d{4}Q[1-4])',2)) AS period FROM listing) x WHERE state<>'') y WHERE rn=1""")
def a3(t):
    return files.latest_rate_files(t.listing)


@derived("listing", """
SELECT event_id AS pos, chr(CAST(65+user_id%26 AS INT))||chr(CAST(97+user_id%7 AS INT))||CASE WHEN user_id%9=0 THEN 'X' ELSE 'R' END||CAST(2020+event_id%5 AS VARCHAR)||'Q'||CAST(1+event_id%5 AS VARCHAR)||'D'||CAST(event_id AS VARCHAR)||'.csv' AS filename FROM events""")
def listing(t):
    u, e = c("user_id"), c("event_id")
    return t.events.select(e.alias("pos"), F.concat(F.chr((65 + u % 26)), F.chr((97 + u % 7)), F.when(u % 9 == 0, "X").otherwise("R"), (2020 + e % 5).cast("string"),
                                                    F.lit("Q"), (1 + e % 5).cast("string"), F.lit("D"), e.cast("string"), F.lit(".csv")).alias("filename"))


@derived("pop_rows", """
SELECT CASE c_custkey%6 WHEN 0 THEN '040' WHEN 1 THEN '050' WHEN 2 THEN '162' WHEN 3 THEN '170' WHEN 4 THEN '061' ELSE '157' END AS sumlev, lpad(CAST(c_nationkey+1 AS VARCHAR),2,'0') AS state,
 lpad(CAST(c_custkey%300 AS VARCHAR),3,'0') AS county, lpad(CAST(c_custkey%700 AS VARCHAR),5,'0') AS place, lpad(CAST(c_custkey%500 AS VARCHAR),5,'0') AS cousub,
 CASE WHEN c_custkey%13=0 THEN 'N/A' ELSE CAST(c_custkey*10 AS VARCHAR) END AS pop_text, c_custkey AS rank FROM customer""")
def pop_rows(t):
    k = c("c_custkey")
    lv = None
    for i, v in enumerate(("040", "050", "162", "170", "061")):
        lv = F.when(k % 6 == i, v) if lv is None else lv.when(k % 6 == i, v)
    pad = lambda m, n: F.lpad((k % m).cast("string"), n, "0")
    return t.customer.select(lv.otherwise("157").alias("sumlev"), F.lpad((c("c_nationkey") + 1).cast("string"), 2, "0").alias("state"), pad(300, 3).alias("county"),
                             pad(700, 5).alias("place"), pad(500, 5).alias("cousub"), F.when(k % 13 == 0, "N/A").otherwise((k * 10).cast("string")).alias("pop_text"), k.alias("rank"))


@query("a7_populations", """SELECT geoid, arg_max(TRY_CAST(pop_text AS BIGINT), rank) FILTER (WHERE TRY_CAST(pop_text AS BIGINT) IS NOT NULL) AS population FROM (
 SELECT *, CASE WHEN sumlev='040' THEN state WHEN sumlev='050' THEN state||county WHEN sumlev IN ('162','170') THEN state||place WHEN sumlev='061' THEN state||county||cousub END AS geoid FROM pop_rows) x
WHERE geoid IS NOT NULL AND TRY_CAST(pop_text AS BIGINT) IS NOT NULL GROUP BY 1""")
def a7(t):
    return files.population_keys(t.pop_rows)


@query("a8_first_per_citation", """SELECT doc_id, state_usps, citation, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY state_usps, snapshot, citation ORDER BY doc_id) AS rn
 FROM (SELECT doc_id, state_usps, snapshot, CASE WHEN doc_id%10=0 THEN NULL ELSE citation END AS citation, text FROM statute_section) s) x WHERE rn=1 OR citation IS NULL""")
def a8(t):
    s = t.statute_section.withColumn("citation", F.when(c("doc_id") % 10 != 0, c("citation")))
    return files.first_per_citation(s, "doc_id").select("doc_id", "state_usps", "citation", F.md5("text").alias("text_md5"))


SQL["archived"] = """
SELECT adapter, url, period_label, sha, label, arrival_seq FROM (
 SELECT adapter, url, period_label, sha, min(arrival_seq) AS arrival_seq, CASE WHEN sha=first_sha THEN period_label ELSE period_label||'@'||substr(sha,1,12) END AS label
 FROM (SELECT *, first_value(sha) OVER (PARTITION BY adapter, url, period_label ORDER BY arrival_seq) AS first_sha FROM archive_arrival) a GROUP BY adapter, url, period_label, sha, first_sha) b"""


@query("a10_archive_rows", "SELECT * FROM archived")
def a10(t):
    return archive.archive_rows(t.archive_arrival)


@query("a11_list_archive", "SELECT * FROM archived WHERE adapter='src1'")
def a11(t):
    return archive.list_archive(archive.archive_rows(t.archive_arrival), "src1")


@query("a11_list_sources", "SELECT id, scope_geoid, authority_tier, name, url FROM source WHERE scope_geoid='05'")
def a11b(t):
    return archive.list_sources(t.source, "05").select("id", "scope_geoid", "authority_tier", "name", "url")


@query("a12_export_sizes", """SELECT 'taxes' AS export, count(*) AS n FROM facts t JOIN jurisdiction j ON j.geoid=t.geoid JOIN source s ON s.id=t.source_id WHERE t.superseded_by IS NULL
UNION ALL SELECT 'coverage', count(*) FROM (SELECT DISTINCT j.state_usps, j.kind, w.category FROM work_item w JOIN jurisdiction j ON j.geoid=w.geoid) x
UNION ALL SELECT 'jurisdictions', count(*) FROM jurisdiction UNION ALL SELECT 'sources', count(*) FROM source UNION ALL SELECT 'state_profiles', count(*) FROM state_profile
UNION ALL SELECT 'coverage_assertions', count(*) FROM coverage_assertion UNION ALL SELECT 'thresholds', count(*) FROM thresholds UNION ALL SELECT 'authority_caps', count(*) FROM grants
UNION ALL SELECT 'headroom', count(*) FROM head_room UNION ALL SELECT 'ballot_measures', count(*) FROM measures b JOIN jurisdiction j ON j.geoid=b.geoid WHERE b.superseded_by IS NULL""")
def a12(t):
    out = None
    for name, df in archive.exports(t).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("export"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a13_tax_export", f"""SELECT {', '.join({'jurisdiction': 'j.name AS jurisdiction', 'source_name': 's.name AS source_name', 'source_url': 's.url AS source_url'}.get(x, x if x in ('state_usps', 'kind', 'population', 'authority_tier') else 't.' + x) for x in archive.TAX_COLUMNS)}
FROM facts t JOIN jurisdiction j ON j.geoid=t.geoid JOIN source s ON s.id=t.source_id WHERE t.superseded_by IS NULL""")
def a13(t):
    return archive.tax_export(t.facts, t.jurisdiction, t.source)


@query("a14_new_documents", """SELECT sha256, url, arrival_seq FROM (SELECT sha AS sha256, url, arrival_seq, row_number() OVER (PARTITION BY sha, url ORDER BY arrival_seq) AS rn FROM archive_arrival) x
WHERE rn=1 AND NOT EXISTS (SELECT 1 FROM archive_arrival h WHERE h.adapter='src3' AND h.sha=x.sha256 AND h.url=x.url)""")
def a14(t):
    a = t.archive_arrival.select(c("sha").alias("sha256"), "url", "arrival_seq", "adapter")
    return spine.new_documents(a.where(c("adapter") == "src3"), a.drop("adapter"))


@query("a15_ad_hoc_sql", """SELECT j.state_usps, count(*) AS n, round(avg(t.rate_value),6) AS mean_rate FROM facts t JOIN jurisdiction j ON j.geoid=t.geoid WHERE t.status='levied' GROUP BY 1 ORDER BY 1 LIMIT 100""")
def a15(t):
    return archive.ask(t.spark, {"facts": t.facts, "jurisdiction": t.jurisdiction},
                       "SELECT j.state_usps, count(*) AS n, round(avg(t.rate_value),6) AS mean_rate FROM {facts} t JOIN {jurisdiction} j ON j.geoid=t.geoid "
                       "WHERE t.status='levied' GROUP BY 1 ORDER BY 1")
