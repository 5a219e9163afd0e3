"""Queries: page and text jobs (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import pages
from .fixtures import NEEDS, SQL, derived
from .registry import query

c = F.col
null = lambda k: F.lit(None).cast(k)


def _any(x, parts): return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"
def _host(x): return f"lower(regexp_extract(coalesce({x},''),'^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)',1))"
def _path(x): return f"regexp_extract(coalesce({x},''),'^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)',1)"
def _query(x): return f"regexp_extract(coalesce({x},''),'^[^?#]*\\?([^#]*)',1)"
def _last(x): return f"regexp_extract({_path(x)},'([^/]*)$',1)"
def _ext(x): return f"CASE WHEN contains({_last(x)},'.') THEN lower(regexp_extract({_last(x)},'(\\.[^.]*)$',1)) ELSE '' END"
def _in(v): return "(" + ",".join(f"'{x}'" for x in v) + ")"


#: Tables and table rows of a made page, and words of its long link: more than any cut would leave.
TABLES, ROWS, LONG = 14, 90, 60
NL = "chr(10)"
SQL["made_page"] = f"""SELECT c_custkey AS page_id, c_name AS name, 't'||CAST(c_custkey AS STRING) AS phone, c_mktsegment AS seg, 'https://site.example/dir/page'||CAST(c_custkey AS STRING) AS url, CASE WHEN c_custkey%6=0 THEN 404 WHEN c_custkey%6=1 THEN CAST(NULL AS INT) ELSE 200 END AS http_status,
'<html><head><title>'||c_name||'</title><script>var x="<p>no</p>";</script></head><body><nav><a href="/menu">Menu</a> top</nav><form action="/q"><p>Rates of '||c_mktsegment||'</p>'
||repeat('<table><tr><th>Kind</th><td>t'||CAST(c_custkey AS STRING)||'</td></tr></table>',{TABLES})||'<table>'||repeat('<tr><td>'||c_mktsegment||'</td><td></td></tr>',{ROWS})||'</table><p><a href="docs/'||CAST(c_custkey AS STRING)||'.pdf#page=2">'||repeat('long ',{LONG})||c_name
||'</a> &amp; more</p><a href="mailto:x@y.z">mail</a><footer>end <a href="https://other.example/t'||CAST(c_custkey AS STRING)||'">Foot</a></footer></body></html>' AS html FROM customer"""
SQL["made_text"] = f"""SELECT *, '# '||name||{NL}||{NL}||'TABLES:'||{NL}||repeat('Kind | '||phone||{NL}||{NL},{TABLES})||repeat(seg||' | '||{NL},{ROWS - 1})||seg||' | '||{NL}||{NL}
||name||{NL}||'Rates of '||seg||{NL}||repeat('Kind'||{NL}||phone||{NL},{TABLES})||repeat(seg||{NL},{ROWS})||repeat('long ',{LONG})||name||{NL}||'& more'||{NL}||'mail' AS text FROM made_page"""
NEEDS["made_page"] = ["customer"]


def _parsed(t, html):
    """Pages parsed by as many tasks as a shuffle has, however few files hold them."""
    return pages.parse_pages(html, int(t.spark.conf.get("spark.sql.shuffle.partitions")))


def _made(t, which="true"):
    """Made pages, or some, parsed by as many tasks; their customers are dealt, before the html is written, as that is many times longer."""
    t.keep("customer", t.customer.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey"))
    return pages.parse_pages(t.made_page.where(which))


@query("l1_page_text", "SELECT page_id, url, name AS title, text FROM made_text")
def l1(t):
    return _made(t).select("page_id", "url", "title", "text")


@query("l1_raw_page_text")
def l1b(t):
    return _parsed(t, t.pages).select("page_id", "url", "title", "text")


@query("l2_page_links", f"""SELECT page_id, url, CAST(0 AS INT) AS pos, 'https://site.example/menu' AS href, 'Menu' AS anchor FROM made_page
UNION ALL SELECT page_id, url, CAST(1 AS INT), 'https://site.example/dir/docs/'||CAST(page_id AS STRING)||'.pdf', repeat('long ',{LONG})||name FROM made_page
UNION ALL SELECT page_id, url, CAST(2 AS INT), 'https://other.example/'||phone, 'Foot' FROM made_page""")
def l2(t):
    return pages.explode_links(_made(t))


@query("l2_raw_page_links")
def l2b(t):
    return pages.explode_links(_parsed(t, t.pages))


@derived("page_urls", """
SELECT page_id, state_usps AS geoid, CASE page_id%3 WHEN 0 THEN 'property' WHEN 1 THEN 'elections' ELSE 'sales_use' END AS category, 'Franklin Nation '||CAST(CAST(state_usps AS INT) AS VARCHAR) AS name, 'oh' AS state,
 CASE page_id%11 WHEN 0 THEN 'https://franklinnation'||CAST(CAST(state_usps AS INT) AS VARCHAR)||'county.org/tax' WHEN 1 THEN 'https://www.tax.ohio.gov/rates/'||CAST(page_id AS VARCHAR)||'.pdf' WHEN 2 THEN 'https://co.franklinnation'||CAST(CAST(state_usps AS INT) AS VARCHAR)||'.oh.us/Auditor//'
  WHEN 3 THEN 'https://www.facebook.com/franklinnation' WHEN 4 THEN 'https://franklinnation'||CAST(CAST(state_usps AS INT) AS VARCHAR)||'news.com/' WHEN 5 THEN 'http://Sub.TheRat.example.NET:8080/Elections/?id='||CAST(page_id%4 AS VARCHAR)||'#frag'
  WHEN 6 THEN 'https://cityoffranklinnation'||CAST(CAST(state_usps AS INT) AS VARCHAR)||'.com/img/logo.png' WHEN 7 THEN 'mailto:clerk@x.gov' ELSE url END AS href,
 CASE page_id%5 WHEN 0 THEN 'Property tax rates' WHEN 1 THEN 'Board of elections' WHEN 2 THEN 'Finance office' WHEN 3 THEN 'Mill Rate history' END AS anchor, CAST(page_id%2 AS INT) AS depth FROM crawl_page""")
def page_urls(t):
    p, s = c("page_id"), c("state_usps").cast("int").cast("string")
    k = p % 11
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    href = (F.when(k == 0, cat("https://franklinnation", s, "county.org/tax")).when(k == 1, cat("https://www.tax.ohio.gov/rates/", p.cast("string"), ".pdf"))
            .when(k == 2, cat("https://co.franklinnation", s, ".oh.us/Auditor//")).when(k == 3, F.lit("https://www.facebook.com/franklinnation"))
            .when(k == 4, cat("https://franklinnation", s, "news.com/")).when(k == 5, cat("http://Sub.TheRat.example.NET:8080/Elections/?id=", (p % 4).cast("string"), "#frag"))
            .when(k == 6, cat("https://cityoffranklinnation", s, ".com/img/logo.png")).when(k == 7, F.lit("mailto:clerk@x.gov")).otherwise(c("url")))
    a = p % 5
    return t.crawl_page.select(
        p, c("state_usps").alias("geoid"), F.when(p % 3 == 0, "property").when(p % 3 == 1, "elections").otherwise("sales_use").alias("category"), cat("Franklin Nation ", s).alias("name"), F.lit("oh").alias("state"),
        href.alias("href"), F.when(a == 0, "Property tax rates").when(a == 1, "Board of elections").when(a == 2, "Finance office").when(a == 3, "Mill Rate history").alias("anchor"), (p % 2).cast("int").alias("depth"))


H = f"rtrim({_host('href')}, '.')"
TAIL = "|".join(fixed.NAME_TAIL_WORDS)
SQL["hosted"] = f"SELECT *, {H} AS host, regexp_replace({H},'[^a-z0-9]','','g') AS flat, regexp_replace(regexp_replace(lower(name),'[^a-z0-9]','','g'), '({TAIL})$', '') AS core FROM page_urls"
SQL["classified"] = f"""SELECT *, (host<>'' AND NOT blocked AND NOT {_any('host', fixed.MEDIA_HOST_PARTS)} AND (regexp_matches(host,'(^|\\.)(gov|us|mil|org)$') OR {_any('host', fixed.CIVIC_COM_PARTS)}) AND length(core)>=4 AND contains(flat, core)
  AND ({_any('host', [*fixed.CIVIC_HOST_PARTS, 'ci.', 'co.'])} OR {_any('flat', fixed.CIVIC_HOST_PARTS)} OR contains(replace(host,'-',''), lower(state)) OR gov)) AS own_site
FROM (SELECT *, regexp_matches(host,'(^|\\.)(gov|mil)$') OR regexp_matches(host,'\\.us$') AS gov, {_any('host', fixed.BLOCKED_HOST_PARTS)} AS blocked FROM hosted) x"""
SQL["allowed_links"] = """SELECT *, host<>'' AND NOT blocked AND (host='therat.example.net' OR host LIKE '%.therat.example.net' OR gov OR own_site) AS allowed, host<>'' AND NOT blocked AND (gov OR own_site) AS official FROM classified"""


@query("l4_classify_hosts", "SELECT page_id, host, gov, blocked, own_site, official, allowed FROM allowed_links")
def l4(t):
    return _allowed(t).select("page_id", "host", "gov", "blocked", "own_site", "official", "allowed")


def _allowed(t):
    seeds = t.page_urls.select("geoid", "category").distinct().withColumn("seed_host", F.lit("therat.example.net"))
    return pages.allowed_hosts(pages.classify_hosts(t.page_urls, "href"), seeds)


BLOB = f"{_path('href')}||'?'||{_query('href')}||' '||coalesce(anchor,'')"


@query("l3_select_links", f"""SELECT page_id, href, anchor, preferred FROM (SELECT *, ext IN {_in(fixed.DOCUMENT_EXTENSIONS)} OR relevant AS preferred FROM (
 SELECT *, ext NOT IN {_in(fixed.SKIPPED_EXTENSIONS)} AND (regexp_matches(blob,'(?i){fixed.TAX_PAGE_PATTERN}') OR regexp_matches(blob,'(?i)mill[\\s_\\-]?rate') OR ext IN {_in(fixed.DOCUMENT_EXTENSIONS)}) AS relevant
 FROM (SELECT *, {BLOB} AS blob, {_ext('href')} AS ext FROM allowed_links) a) b) d
WHERE allowed AND (preferred OR (category='elections' AND regexp_matches(blob,'(?i){fixed.ELECTION_PAGE_PATTERN}')) OR (depth=0 AND regexp_matches(blob,'(?i){fixed.OFFICE_PATTERN}')))""")
def l3(t):
    return pages.select_links(_allowed(t), "mill rate").select("page_id", "href", "anchor", "preferred")


SQL["results"] = "SELECT geoid, category, name, state, href AS url, 'q'||CAST(page_id%4 AS VARCHAR) AS query, page_id%4 AS query_pos, page_id AS rank FROM page_urls"
SQL["kept"] = """SELECT geoid, category, url, query, kept_rank FROM (SELECT *, row_number() OVER (PARTITION BY geoid, category ORDER BY query_pos, rank, url) AS kept_rank FROM (
 SELECT geoid, category, href AS url, 'q'||CAST(page_id%4 AS VARCHAR) AS query, page_id%4 AS query_pos, page_id AS rank, row_number() OVER (PARTITION BY geoid, category, href ORDER BY page_id%4, page_id) AS rn FROM allowed_links WHERE official) x WHERE rn=1) y"""


def _results(t):
    p = c("page_id")
    return t.page_urls.select("geoid", "category", "name", "state", c("href").alias("url"), F.concat(F.lit("q"), (p % 4).cast("string")).alias("query"), (p % 4).alias("query_pos"), p.alias("rank"))


@query("l5_keep_results", "SELECT * FROM kept")
def l5(t):
    return pages.keep_results(_results(t))


@query("l5_kept_per_query", "SELECT geoid, category, query, count(*) AS kept FROM kept GROUP BY 1,2,3")
def l5b(t):
    return pages.kept_per_query(pages.keep_results(_results(t)))


KEY = f"""lower(regexp_extract(href,'^([A-Za-z][A-Za-z0-9+.\\-]*):',1))||'://'||{_host('href')}||CASE WHEN regexp_replace({_path('href')},'/+$','')='' THEN '/' ELSE regexp_replace({_path('href')},'/+$','') END||CASE WHEN {_query('href')}<>'' THEN '?'||{_query('href')} ELSE '' END"""


@query("l6_dedupe_links", f"SELECT page_id, geoid, url_key FROM (SELECT page_id, geoid, {KEY} AS url_key, row_number() OVER (PARTITION BY geoid, {KEY} ORDER BY page_id) AS rn FROM page_urls) x WHERE rn=1")
def l6(t):
    return pages.dedupe_links(t.page_urls, ["geoid"], ["page_id"]).select("page_id", "geoid", "url_key")


@derived("doc_pages", """
SELECT doc_id, lpad(CAST(doc_id%25+1 AS VARCHAR),2,'0') AS geoid, CASE doc_id%3 WHEN 0 THEN 'property' WHEN 1 THEN 'elections' ELSE 'sales_use' END AS category, CASE WHEN doc_id%10=0 THEN 'https://x.gov/a.pdf' ELSE 'https://x.gov/rates' END AS url,
 CASE WHEN doc_id%13=0 THEN 'application/pdf' ELSE 'text/html' END AS content_type, CASE WHEN doc_id%17=0 THEN '' WHEN doc_id%7=0 THEN text||' precinct ' WHEN doc_id%6=0 THEN text||' mill-rate ' ELSE text END AS text,
 CASE WHEN doc_id%9=0 THEN 'HTTP 500' END AS error, CASE WHEN doc_id%4=0 THEN 'Rates '||CAST(doc_id AS VARCHAR) WHEN doc_id%4=1 THEN '' END AS title, md5(text) AS sha256 FROM documents""")
def doc_pages(t):
    d = c("doc_id")
    return t.documents.select(
        d, F.lpad((d % 25 + 1).cast("string"), 2, "0").alias("geoid"), F.when(d % 3 == 0, "property").when(d % 3 == 1, "elections").otherwise("sales_use").alias("category"),
        F.when(d % 10 == 0, "https://x.gov/a.pdf").otherwise("https://x.gov/rates").alias("url"), F.when(d % 13 == 0, "application/pdf").otherwise("text/html").alias("content_type"),
        F.when(d % 17 == 0, "").when(d % 7 == 0, F.concat("text", F.lit(" precinct "))).when(d % 6 == 0, F.concat("text", F.lit(" mill-rate "))).otherwise(c("text")).alias("text"),
        F.when(d % 9 == 0, "HTTP 500").alias("error"), F.when(d % 4 == 0, F.concat(F.lit("Rates "), d.cast("string"))).when(d % 4 == 1, "").alias("title"), F.md5("text").alias("sha256"))


SQL["judged_pages"] = f"""SELECT *, is_document OR (text<>'' AND (regexp_matches(text,'(?i){fixed.TAX_PAGE_PATTERN}') OR regexp_matches(text,'(?i)mill[\\s_\\-]?rate') OR (category='elections' AND regexp_matches(text,'(?i){fixed.ELECTION_PAGE_PATTERN}')))) AS relevant
FROM (SELECT *, {_ext('url')} IN {_in(fixed.DOCUMENT_EXTENSIONS)} OR contains(content_type,'pdf') AS is_document FROM doc_pages) x"""


@query("l7_content_relevant", "SELECT doc_id, is_document, relevant FROM judged_pages")
def l7(t):
    return pages.content_relevant(t.doc_pages, "mill rate").select("doc_id", "is_document", "relevant")


STATUTE_TAILS = {0: " Sales Tax", 1: " lodging", 2: " special election", 3: " Franchise", 4: " home rule"}


@derived("statutes", "SELECT doc_id, state_usps, snapshot, citation, section_title, text||CASE doc_id%9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in STATUTE_TAILS.items()) + " ELSE '' END AS text FROM statute_section")
def statutes(t):
    tail = None
    for k, v in STATUTE_TAILS.items():
        tail = F.when(c("doc_id") % 9 == k, v) if tail is None else tail.when(c("doc_id") % 9 == k, v)
    return t.statute_section.withColumn("text", F.concat("text", tail.otherwise("")))


@query("l8_statutes_by_category", "SELECT state_usps, category, citation, section_title, doc_id FROM statute_hits")
def l8(t):
    return pages.statutes_by_category(t.statutes)


@query("l9_page_signal", f"""SELECT geoid, category, bool_or((is_document AND length(text)>0 AND error IS NULL) OR (length(text)>400 AND regexp_matches(text,'(?i){fixed.TAX_PAGE_PATTERN}'))) AS has_signal,
 count(*) FILTER (WHERE error IS NULL AND length(text)>0 AND contains(content_type,'html') AND length(text)<400) AS thin_pages FROM judged_pages GROUP BY 1,2""")
def l9(t):
    return pages.page_signal(pages.content_relevant(t.doc_pages, "mill rate").withColumn("byte_size", F.length("text")))


SQL["page_texts"] = "SELECT *, row_number() OVER (PARTITION BY geoid, category, sha256 ORDER BY doc_id) AS rn FROM judged_pages WHERE error IS NULL AND text<>''"


@query("l10_combine_texts", """SELECT geoid, category, md5(CASE WHEN length(t)>80000 THEN substr(t,1,80000)||chr(10)||chr(10)||'[truncated]' ELSE t END) AS combined_md5, CAST(length(CASE WHEN length(t)>80000 THEN substr(t,1,80000)||chr(10)||chr(10)||'[truncated]' ELSE t END) AS INT) AS n
FROM (SELECT geoid, category, string_agg('URL: '||url||chr(10)||CASE WHEN title<>'' THEN 'TITLE: '||title||chr(10) ELSE '' END||text, chr(10)||chr(10)||'-----'||chr(10)||chr(10) ORDER BY CASE WHEN is_document THEN 0 ELSE 1 END, doc_id) AS t FROM page_texts WHERE rn=1 GROUP BY 1,2) x""")
def l10(t):
    p = pages.content_relevant(t.doc_pages, "mill rate").where(c("error").isNull() & (c("text") != "")).withColumn("page_order", c("doc_id"))
    return pages.combine_texts(p, 80000).select("geoid", "category", F.md5("combined").alias("combined_md5"), F.length("combined").alias("n"))


@query("l11_page_record", f"""SELECT page_id, http_status, CASE WHEN http_status NOT BETWEEN 200 AND 399 THEN 'HTTP '||CAST(http_status AS VARCHAR) END AS error, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS byte_size,
 CASE WHEN page_id%5=0 THEN 0 ELSE length(text) END AS text_chars FROM made_text""")
def l11(t):
    texts = _made(t, "page_id % 5 <> 0")
    fetched = t.made_page.select("page_id", "http_status", c("html").alias("body"))
    return pages.page_record(fetched, texts)


def _passage(terms):
    """800 characters from 200 before the first hit in the text."""
    first = "least(" + ", ".join(f"coalesce(nullif(instr(lower(text), '{w.strip().lower()}'), 0), length(text) + 1)" for w in terms) + ")"
    return f"substr(text, CASE WHEN {first} <= length(text) THEN greatest({first} - 200, 1) ELSE 1 END, 800)"


def _like(w): return " OR ".join(f"{f} ILIKE '%{w}%'" for f in ("section_title", "text", "citation"))


@query("l12_search_statutes", f"""SELECT state_usps, citation, section_title, {_passage(('the', 'sec. 1', 'src3'))} AS excerpt, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY state_usps ORDER BY citation, doc_id) AS rn FROM statute_section
 WHERE {' OR '.join(_like(w) for w in ('the', 'sec. 1', 'src3'))}) x WHERE rn<=25""")
def l12(t):
    return pages.search_statutes(t.statute_section, None, ["the", "sec. 1", "src3"])


@query("l12_default_terms", f"""SELECT state_usps, citation, section_title, {_passage(fixed.DEFAULT_STATUTE_TERMS)} AS excerpt, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY state_usps ORDER BY citation, doc_id) AS rn FROM statutes
 WHERE {' OR '.join(_like(w) for w in fixed.DEFAULT_STATUTE_TERMS)}) x WHERE rn<=25""")
def l12b(t):
    return pages.search_statutes(t.statutes, None)
