"""Page and text jobs.

HTML parsing has no SQL form: it runs in ``mapInPandas``, one small parser per
page.  Everything after that is column expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import (alnum, any_of, contains_any, is_document_url, keyword_pattern, path_ext,
                              url_host, url_path, url_query, url_scheme)
from ..functions.scan import Scan, first_rows, running

c = F.col
ITEM = ["geoid", "category"]

# -- L1, L2 -----------------------------------------------------------------

_WS = " "
#: Tags without attributes: most of a page's, and nothing in them is left to read.
_PLAIN_START, _PLAIN_END = re.compile("<([A-Za-z][A-Za-z0-9]*)>"), re.compile("</([A-Za-z][A-Za-z0-9]*)>")
#: Tags whose content the library reads by rules of their own.
_OWN_RULES = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


class _Page(HTMLParser):
    """The page's tags and texts in order, and which start tags have an end tag of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []
        self.open: list[tuple[str, int]] = []
        self.n_open: Counter = Counter()
        self.closed: set[int] = set()

    def parse_starttag(self, i):
        m = _PLAIN_START.match(self.rawdata, i)
        if m is None or (tag := m[1].lower()) in _OWN_RULES:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, ())
        return m.end()

    def parse_endtag(self, i):
        m = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def updatepos(self, i, j):   # lines are not counted
        return j

    def handle_starttag(self, tag, attrs):
        if tag not in fixed.VOID_TAGS:
            self.open.append((tag, len(self.events)))
            self.n_open[tag] += 1
        self.events.append(("start", tag, dict(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.events.append(("start", tag, dict(attrs)))
        self.events.append(("end", tag, None))

    def handle_endtag(self, tag):
        start = None
        if self.n_open.get(tag):   # tags left open inside it end here as well
            name = None
            while name != tag:
                name, start = self.open.pop()
                self.n_open[name] -= 1
            self.closed.add(start)
        self.events.append(("end", tag, start))

    def handle_data(self, data):
        if text := data.strip():
            self.events.append(("text", text, None))


def _parts(page: _Page) -> tuple[list[str], list[str], list[list], list[tuple]]:
    """Title words, text lines, tables (rows of cells) and links (href, words).

    Text inside dropped tags is left out; a dropped tag that is never closed drops
    nothing, or the rest of the page would go with it.
    """
    title, lines, tables, links = [], [], [], []
    skip, in_title, anchor, cell, open_tables = 0, False, None, None, []
    for i, (kind, tag, more) in enumerate(page.events):
        if kind == "text":
            if in_title:
                title.append(tag)
            if anchor:
                anchor[1].append(tag)
            if not skip:
                lines.append(tag)
                if cell is not None:
                    cell.append(tag)
        elif kind == "start":
            skip += tag in fixed.DROPPED_TAGS and i in page.closed
            in_title = in_title or tag == "title" and not title
            if tag == "a":
                anchor = [more["href"], []] if more.get("href") is not None else None
            if skip:
                continue
            if tag == "table":
                open_tables.append([])
                tables.append(open_tables[-1])
            elif tag == "tr" and open_tables:
                open_tables[-1].append([])
            elif tag in ("td", "th") and open_tables and open_tables[-1]:
                cell = []
                open_tables[-1][-1].append(cell)
        else:
            skip -= tag in fixed.DROPPED_TAGS and more is not None
            if tag == "title":
                in_title = False
            elif tag == "a" and anchor:
                links.append((anchor[0], _WS.join(anchor[1])))
                anchor = None
            elif tag in ("td", "th"):
                cell = None
            elif tag == "table" and open_tables:
                open_tables.pop()
    return title, lines, tables, links


def _parse(url: str, html: str) -> tuple[str, str, list[dict]]:
    page = _Page()
    page.feed(html or "")
    page.close()
    words, lines, rows_of, found = _parts(page)
    title = _WS.join(words)
    tables = []
    for rows in rows_of:
        cells = [[_WS.join(cell) for cell in row] for row in rows]
        if kept := [" | ".join(row) for row in cells if any(row)]:
            tables.append("\n".join(kept))
    parts = ["# " + title] if title else []
    if tables:
        parts.append("TABLES:\n" + "\n\n".join(tables))
    parts.append("\n".join(lines))
    links = []
    for href, anchor in found:
        try:
            full = urlparse(urljoin(url or "", href))
        except ValueError:
            continue
        if full.scheme in ("http", "https"):
            links.append({"href": full._replace(fragment="").geturl(), "anchor": anchor})
    return title, "\n\n".join(parts), links


def parse_pages(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """L1 + L2: page_id, url -> title, text, links array<struct<href, anchor>>; whole pages, one pass.

    With ``parts`` the pages are dealt over so many tasks first, by a hash of id and
    url; without, a task parses what its split holds, which suits tables of many files.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [_parse(u, h) for u, h in zip(b["url"], b["html"])]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "title": [x[0] for x in parsed],
                                "text": [x[1] for x in parsed], "links": [x[2] for x in parsed]})
    read = pages.select("page_id", "url", "html")
    return (read.repartition(parts, "page_id", "url") if parts else read).mapInPandas(
        run, "page_id long, url string, title string, text string, links array<struct<href:string,anchor:string>>")


def explode_links(parsed: DataFrame) -> DataFrame:
    """L2: one row per link, in page order."""
    return parsed.select("page_id", "url", F.posexplode("links").alias("pos", "l")) \
        .select("page_id", "url", "pos", "l.href", "l.anchor")


# -- hosts ------------------------------------------------------------------

def is_gov_host(host: Column) -> Column:
    return host.rlike(r"(^|\.)(gov|mil)$") | host.rlike(r"\.us$")


def is_blocked_host(host: Column) -> Column:
    return contains_any(host, fixed.BLOCKED_HOST_PARTS)


def looks_like_place_host(host: Column, name: Column, state: Column) -> Column:
    """A host that carries the place's own name and a civic word, its state, or a public suffix."""
    official = host.rlike(r"(^|\.)(gov|us|mil|org)$") | contains_any(host, fixed.CIVIC_COM_PARTS)
    flat = alnum(host)
    core = F.regexp_replace(alnum(name), "(" + "|".join(fixed.NAME_TAIL_WORDS) + ")$", "")
    named = (F.length(core) >= 4) & flat.contains(core)
    civic = contains_any(host, [*fixed.CIVIC_HOST_PARTS, "ci.", "co."]) | contains_any(flat, fixed.CIVIC_HOST_PARTS)
    stated = (F.coalesce(state, F.lit("")) != "") & F.replace(host, F.lit("-"), F.lit("")).contains(F.lower(state))
    return ((host != "") & ~is_blocked_host(host) & ~contains_any(host, fixed.MEDIA_HOST_PARTS)
            & official & named & (civic | F.coalesce(stated, F.lit(False)) | is_gov_host(host)))


def classify_hosts(rows: DataFrame, url: str = "url") -> DataFrame:
    """L4: adds host, gov, blocked, own_site and official; rows carry the place's name and state."""
    host = F.rtrim(url_host(c(url)), F.lit("."))
    r = rows.withColumn("host", host)
    own = F.coalesce(looks_like_place_host(c("host"), c("name"), c("state")), F.lit(False))
    return r.withColumn("gov", is_gov_host(c("host"))).withColumn("blocked", is_blocked_host(c("host"))).withColumn("own_site", own) \
        .withColumn("official", (c("host") != "") & ~c("blocked") & (c("gov") | c("own_site")))


def allowed_hosts(classified: DataFrame, seeds: DataFrame) -> DataFrame:
    """L4: adds ``allowed``: a seed host of the item or one below it, or an official one.

    A host is looked up by each of its own suffixes, so this is an equi join.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = classified.select(*ITEM, "host").distinct().withColumn("seed_host", F.explode(suffixes)) \
        .join(seeds.select(*ITEM, "seed_host").distinct(), [*ITEM, "seed_host"], "left_semi") \
        .select(*ITEM, "host").distinct().withColumn("_seeded", F.lit(True))
    j = classified.join(hit, [*ITEM, "host"], "left")
    return j.withColumn("allowed", (c("host") != "") & ~c("blocked") & (F.coalesce("_seeded", F.lit(False)) | c("gov") | c("own_site"))).drop("_seeded")


def keep_results(results: DataFrame, n: int | None = None) -> DataFrame:
    """Official results per item, each URL once, numbered in (query, rank) order; all of them, or the first n."""
    # Hosts repeat far more than URLs do: classify each (host, place) once.
    named = results.withColumn("_host", url_host(c("url")))
    who = ["_host", "name", "state"]
    hosts = classify_hosts(named.select(*who).distinct().withColumn("_u", F.concat(F.lit("http://"), c("_host"))), "_u")
    official = named.join(hosts.where("official").select(*who), who, "left_semi")
    once = official.groupBy(*ITEM, "url").agg(F.min(F.struct("query_pos", "rank", "query")).alias("_at"))
    flat = once.select(*ITEM, "url", c("_at.query").alias("query"), c("_at.query_pos").alias("_q"), c("_at.rank").alias("_r"))
    if n is None:
        ranked = running(flat, ITEM, F.struct("_q", F.floor(c("_r") / 1024)), ["_q", "_r", "url"], [Scan("kept_rank", "sum", F.lit(1).cast("long"))])
    else:
        ranked = first_rows(flat, ITEM, [c("_q"), c("_r"), c("url")], n, "kept_rank")
    return ranked.select(*ITEM, "url", "query", c("kept_rank").cast("long").alias("kept_rank"))


def kept_per_query(kept: DataFrame) -> DataFrame:
    """L5."""
    return kept.groupBy(*ITEM, "query").agg(F.count("*").alias("kept"))


# -- links ------------------------------------------------------------------

def select_links(links: DataFrame, extra_keywords: str = "") -> DataFrame:
    """L3: links worth fetching, ``preferred`` for documents and rate pages.

    Rows carry href, anchor, depth, category and ``allowed`` (L4).  Only path,
    query and anchor are searched, never the host.
    """
    blob = F.concat(url_path(c("href")), F.lit("?"), url_query(c("href")), F.lit(" "), F.coalesce("anchor", F.lit("")))
    ext = path_ext(url_path(c("href")))
    extra = keyword_pattern(extra_keywords)
    word = blob.rlike("(?i)" + fixed.TAX_PAGE_PATTERN)
    if extra:
        word = word | blob.rlike("(?i)" + extra)
    doc = ext.isin(fixed.DOCUMENT_EXTENSIONS)
    relevant = ~ext.isin(fixed.SKIPPED_EXTENSIONS) & (word | doc)
    follow = (doc | relevant | ((c("category") == "elections") & blob.rlike("(?i)" + fixed.ELECTION_PAGE_PATTERN))
              | ((c("depth") == 0) & blob.rlike("(?i)" + fixed.OFFICE_PATTERN)))
    return links.where(c("allowed") & follow).withColumn("preferred", doc | relevant)


def url_key(url: Column) -> Column:
    """Scheme, lower-case host, path without trailing slashes, query; no fragment."""
    path = F.regexp_replace(url_path(url), "/+$", "")
    q = url_query(url)
    return F.concat(url_scheme(url), F.lit("://"), url_host(url), F.when(path == "", "/").otherwise(path),
                    F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def dedupe_links(links: DataFrame, keys: list[str], order: list[str], url: str = "href") -> DataFrame:
    """The first link per normalised URL."""
    k = links.withColumn("url_key", url_key(c(url)))
    return first_rows(k, [*keys, "url_key"], [c(o) for o in order])


# -- page content -----------------------------------------------------------

def content_relevant(pages: DataFrame, extra_keywords: str = "") -> DataFrame:
    """Adds ``relevant``: documents always, other pages by the words in their whole text."""
    doc = is_document_url(c("url")) | F.coalesce(c("content_type").contains("pdf"), F.lit(False))
    word = c("text").rlike("(?i)" + fixed.TAX_PAGE_PATTERN)
    extra = keyword_pattern(extra_keywords)
    if extra:
        word = word | c("text").rlike("(?i)" + extra)
    vote = (c("category") == "elections") & c("text").rlike("(?i)" + fixed.ELECTION_PAGE_PATTERN)
    return pages.withColumn("is_document", doc) \
        .withColumn("relevant", doc | F.coalesce((c("text") != "") & (word | vote), F.lit(False)))


def page_signal(pages: DataFrame, render_min: int = 400) -> DataFrame:
    """Per item, is there a good document or substantial tax text, and how many pages are thin?

    Rows carry is_document, byte_size, error, text, content_type.
    """
    good = c("is_document") & (c("byte_size") > 0) & c("error").isNull()
    rich = (F.length("text") > 400) & c("text").rlike("(?i)" + fixed.TAX_PAGE_PATTERN)
    thin = c("error").isNull() & (c("byte_size") > 0) & c("content_type").contains("html") & (F.length(F.coalesce("text", F.lit(""))) < render_min)
    return pages.groupBy(*ITEM).agg(F.bool_or(F.coalesce(good | rich, F.lit(False))).alias("has_signal"),
                                    F.count_if(thin).alias("thin_pages"))


def combine_texts(pages: DataFrame, max_chars: int, chunk: Column | None = None) -> DataFrame:
    """One text per item: same bytes once, documents first, then in order, cut with a mark.

    Every page starts with its URL and, where it has one, its title.  Only texts that start before the cut are gathered; where they start is a
    two-level running sum of lengths, so an item with very many pages is never
    pulled into one task.
    """
    sep = len(fixed.PAGE_SEPARATOR)
    head = F.concat_ws("\n", F.concat(F.lit("URL: "), F.coalesce("url", F.lit(""))),
                       F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("TITLE: "), c("title"))), c("text"))
    p = pages.withColumn("text", head).withColumn("_sha", F.coalesce("sha256", F.concat(F.lit("#"), c("page_order").cast("string"))))
    one = p.groupBy(*ITEM, "_sha").agg(F.min_by(F.struct("is_document", "page_order", "text"), "page_order").alias("_p")) \
        .select(*ITEM, (~c("_p.is_document")).cast("int").alias("_late"), c("_p.page_order").alias("page_order"), c("_p.text").alias("text"))
    bucket = F.concat(c("_late").cast("string"), F.lit("/"), F.lpad(F.floor(c("page_order") / 64).cast("string"), 18, "0"))
    lens = running(one, ITEM, chunk if chunk is not None else bucket, ["_late", "page_order"],
                   [Scan("_start", "sum", (F.length("text") + sep).cast("long"), inclusive=False)])
    need = lens.where(F.coalesce("_start", F.lit(0)) <= max_chars)
    g = need.groupBy(*ITEM).agg(F.array_sort(F.collect_list(F.struct("_late", "page_order", F.substring("text", 1, max_chars + 1).alias("text")))).alias("_l"))
    full = F.array_join(F.transform("_l", lambda s: s["text"]), fixed.PAGE_SEPARATOR)
    g = g.withColumn("combined", full)
    cut = F.length("combined") > max_chars
    return g.select(*ITEM, F.when(cut, F.concat(F.substring("combined", 1, max_chars), F.lit(fixed.TRUNCATION_MARK)))
                    .otherwise(c("combined")).alias("combined"))


def page_record(fetched: DataFrame, texts: DataFrame) -> DataFrame:
    """Log rows from fetch results (page_id, status, body): error text, hash, sizes.

    ``texts`` holds the extracted text of pages (L1, or a document reader's); text_chars is
    its length, 0 where nothing was extracted.
    """
    bad = c("http_status").isNotNull() & ~c("http_status").between(200, 399)
    return fetched.withColumn("error", F.when(bad, F.concat(F.lit("HTTP "), c("http_status").cast("string")))) \
        .withColumn("sha256", F.sha2(c("body").cast("binary"), 256)) \
        .withColumn("byte_size", F.octet_length("body").cast("long")) \
        .drop("body").join(texts.select("page_id", F.length("text").cast("long").alias("text_chars")), "page_id", "left") \
        .withColumn("text_chars", F.coalesce("text_chars", F.lit(0).cast("long")))


# -- statutes ---------------------------------------------------------------

def _term_hit(terms: list[str]) -> Column:
    """Case-blind OR of substrings over title, text and citation."""
    pat = "(?i)" + "|".join(r"\Q" + t.strip() + r"\E" for t in terms)
    return any_of(F.coalesce(c(f).rlike(pat), F.lit(False)) for f in ("section_title", "text", "citation"))


def search_statutes(sections: DataFrame, state: str | None, terms: list[str] | None = None, n: int = 25, excerpt_chars: int = 800) -> DataFrame:
    """The first n matching sections by citation, with a passage that holds the first hit; no terms means the standard ones.

    The passage starts a quarter of its length before the hit; a section found by its
    title or citation alone shows its beginning.
    """
    terms = [t for t in (terms or []) if t.strip()] or fixed.DEFAULT_STATUTE_TERMS
    s = sections.where(c("state_usps") == state.upper()) if state else sections
    low = F.lower("text")
    first = F.least(*[F.nullif(F.instr(low, t.strip().lower()), F.lit(0)) for t in terms], F.length("text") + 1)
    start = F.when(first <= F.length("text"), F.greatest(first - excerpt_chars // 4, F.lit(1))).otherwise(F.lit(1))
    return first_rows(s.where(_term_hit(terms)), ["state_usps"], [c("citation"), c("doc_id")], n) \
        .select("state_usps", "citation", "section_title", F.substr(c("text"), start, F.lit(excerpt_chars)).alias("excerpt"), "doc_id")


def statutes_by_category(sections: DataFrame, n: int | None = None) -> DataFrame:
    """Sections per state and category, all or the first n; every category is tested in one pass over the text."""
    cats = F.array_compact(F.array(*[F.when(_term_hit(v), F.lit(k)) for k, v in fixed.STATUTE_TERMS.items()]))
    # sections are dealt before their texts are searched, as a table may lie in one split; an inner explode would search them again to filter
    dealt = sections.select("state_usps", "citation", "section_title", "doc_id", "text").repartition("doc_id")
    hits = dealt.select("state_usps", "citation", "section_title", "doc_id", F.explode_outer(cats).alias("category")).where(c("category").isNotNull())
    return hits if n is None else first_rows(hits, ["state_usps", "category"], [c("citation"), c("doc_id")], n)
