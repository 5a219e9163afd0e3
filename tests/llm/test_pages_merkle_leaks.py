import random

import pytest
from pyspark.sql import functions as F

from levybook.llm import decontaminate, html_templates, merkle

from ..compare import compare, connect
from .cases import documents, empty, prose, texts

PAGE = ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li>Menu</nav>"
        "<div class='cookie-notice'>Accept</div><div class=\"promo-box\">Buy</div><aside>Side</aside><main><h1>Title &amp; more</h1><p><b>One\n  two<br><p>Three&nbsp;four &#169;"
        "<table><tr><td>a<td>b<tr><td>c</table><form><p>mail<input name=x></form><div class=\"share\">Tweet</div><ul><li>x<li>y</ul></main>"
        "<section id=comments><p>first!</p></section><footer>&copy;</footer></body>")


def test_page_parts():
    assert html_templates.main_text(PAGE, set()) == "Title & more\nOne two\nThree four ©\na b\nc\nx\ny"
    assert html_templates.main_text(None, set()) == "" and html_templates.main_text("", set()) == ""
    assert html_templates.main_text("<p>open <nav>menu<article><p>text", set()) == "text"
    assert html_templates.main_text("<article><div class='comments'><p>no</div><p>yes</article>", set()) == "yes"
    assert html_templates.main_text("<div>" * 3000 + "deep", set()) == "deep"
    many = "<article>" + "".join(f"<table><tr><td>{i}</table>" for i in range(40)) + "</article>"
    assert html_templates.main_text(many, set()).count("\n") == 39


def test_template_of_a_host(spark):
    box = "<div><p>Our station plays music since 1990.</p><p>Call us.</p></div>"
    rows = [(i, f"https://A.example/{i}", f"<body>{box}<div><p>{prose(i, 12)}</p></div></body>") for i in range(30)]
    rows += [(100, "https://b.example/", f"<body>{box}<p>own</p></body>"), (101, None, None), (None, "no host", "<p>x"), (3, "https://A.example/3", rows[3][2])]
    df = spark.createDataFrame([(*r, 1, "h", 2) for r in rows], "page_id long, url string, html string, page_key int, host string, template int")
    got = sorted((-1 if r["page_id"] is None else r["page_id"], r["text"], r["n_chars"]) for r in html_templates.page_texts(df).collect())
    want = [(i, prose(i, 12)) for i in range(30)] + [(3, prose(3, 12)), (100, "Our station plays music since 1990.\nCall us.\nown"), (101, ""), (-1, "x")]
    assert got == sorted((i, t, len(t)) for i, t in want)
    assert html_templates.page_texts(df.limit(0)).collect() == []


def test_copies_of_a_page_are_no_template(spark):
    """30 copies of one page on one host, with other surroundings and without a URL, keep the article; what different pages share still goes."""
    copy = f"<h1>{prose(1, 5)}</h1><p>{prose(2, 30)}</p><div><p>{prose(3, 20)}</p></div>"
    text = f"{prose(1, 5)}\n{prose(2, 30)}\n{prose(3, 20)}"
    box = "<div><p>Call us.</p></div>"
    rows = [(i, "https://a.example/p", f"<body><nav>{prose(i, 3)}</nav><div><article data-crawl={i}>{box}{copy}</article></div></body>", text) for i in range(30)]
    rows += [(100 + i, "https://a.example/p", f"<body><article>{box}<p>{prose(40 + i, 12)}</p></article></body>", prose(40 + i, 12)) for i in range(12)]
    rows += [(200 + i, None, f"<body><main>{copy}</main></body>", text) for i in range(30)]
    rows += [(300 + i, "https://b.example/p", f"<body>{copy}</body>", text) for i in range(30)]
    rows += [(400 + i, "https://c.example/p", f"<body><div><article>{copy}</article></div><article><p>{prose(i, 6)}</p></article></body>", f"{text}\n{prose(i, 6)}") for i in range(30)]
    rows += [(500 + i, "https://d.example/p", f"<body><article class=k{i}>{box}</article><span>{i}</span></body>", "Call us.") for i in range(30)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_templates.page_texts(pages).collect()}
    assert got == {r[0]: r[3] for r in rows}
    everything = {h for r in rows for h, _ in html_templates.subtree_hashes(r[2])[1]}
    assert html_templates.main_text(rows[0][2], everything) == f"Call us.\n{text}"


def test_pages_keep_the_article(spark):
    """The test tables' articles come back whole: h1 and paragraphs, character references decoded."""
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_templates.page_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p)


def test_names_are_whole_words_and_articles_are_kept():
    text = lambda html: html_templates.main_text(html, set())
    assert text("<article><h1>A</h1><div class='related-story'><p>para</p></div><section id=search-and-rescue><p>two</p></section><p class='notice-of-motion'>three</p></article>") == "A\npara\ntwo\nthree"
    assert text("<article class='post ad-free'><p>hello</p></article>") == text("<div class='no-sidebar'><p>hello</p></div>") == "hello"
    assert text("<article><p>a <label>b</label></p><div class='related'>c</div><div hidden>no</div><p hidden=''>no</p></article>") == "a b\nc"
    assert text("<p>x</p><div hidden>no</div><div class=a data-x='hidden'>y</div><div title=hidden>z</div>") == "x\ny\nz"
    assert text("<article><div class='ad'>no</div><p>yes</article>") == text("<p>yes</p><div class='sidebar left'>no</div>") == "yes"


def test_menus_and_adverts_go_by_counting(spark, monkeypatch):
    """On the given pages, with articles made plain divs and no name known, what surrounds the text goes because it recurs."""
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host = html_templates.host_of("url")
    big = pages.groupBy(host.alias("host")).count().where("count >= 15").orderBy("host").limit(3)
    some = pages.withColumn("host", host).join(big, "host").select("page_id", "url", F.regexp_replace(F.regexp_replace("html", "(</?)article>", "$1div>"), "(</?)(nav|footer)>", "$1div>").alias("html"))
    some = spark.createDataFrame([(r["page_id"], r["url"], r["html"].replace('class="ad"', 'class="q7"')) for r in some.collect()], "page_id long, url string, html string")
    assert some.count() >= 45
    for r in html_templates.page_texts(some).join(some.select("page_id", "html"), "page_id").collect():
        text = re.search('</div><div>(<h1>.*)</div><div>&copy;', r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", text)]
        lines, links = set(r["text"].split("\n")), set(re.findall("<a [^>]*>([^<]*)</a>", r["html"]))
        assert r["text"].startswith("\n".join(p for p in parts if p))
        assert re.search('<div class="q7">([^<]*)', r["html"])[1] not in lines and not links <= lines


def test_counted_templates_equal_a_plain_count(spark):
    """Which subtrees and structures recur, page by page against dictionaries."""
    r = random.Random(6)
    boxes = ["<div><p>Call us today.</p></div>", "<ul class=m><li><a href=/{0}>go {0}</a></li><li><a href=/x{0}>{1}</a></li></ul>", "<div class=k>{1}</div>", "<div class=body><p>{2}</p></div>", "<section><p>{1}</p></section>"]
    rows = []
    for i in range(120):
        inner = "".join(b.format(i, prose(i, 3), prose(i, 60)) for b in r.sample(boxes, r.randint(1, 5)))
        rows.append((i, f"https://h{i % 3 + (i % 40 == 0) * 5}.example/{i}", f"<body>{inner}<p>{prose(500 + i % 100, 9)}</p></body>"))
    rows += rows[:5]
    hosts = {}
    for _, url, page in rows:
        hosts.setdefault(url.split("/")[2], set()).add(page)
    want = []
    for i, url, page in rows:
        held = [html_templates.subtree_hashes(p) for p in hosts[url.split("/")[2]]]
        bodies = {b for b, _, _ in held}
        pages_of, units, outer = {}, {}, {}
        for body, subtrees, shapes in held:
            for h, u in subtrees:
                pages_of.setdefault(h, set()).add(body)
                units.setdefault(h, set()).add(u)
            per = {}
            for shape, n, linked in shapes:
                per.setdefault(shape, []).append((n, linked))
            for shape, found in per.items():
                outer.setdefault(shape, {})[body] = [sum(x) / len(found) for x in zip(*found)]
        template = {h for h in pages_of if min(len(pages_of[h]), len(units[h])) >= max(10, len(bodies) / 2)}
        shapes = {s for s, x in outer.items() if len(x) >= max(10, len(bodies) / 10) and (sum(n for n, _ in x.values()) <= 25 * len(x) or 2 * sum(k for _, k in x.values()) >= sum(n for n, _ in x.values()))}
        want.append((i, html_templates.main_text(page, template, shapes)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((x["page_id"], x["text"]) for x in html_templates.page_texts(pages).collect())
    assert got == sorted(want) and any("Call us" in p and "Call us" not in t for (_, _, p), (_, t) in zip(sorted(rows), got))


def test_merkle_equals_sql(spark, tmp_path):
    import duckdb
    docs = documents(spark).where("text IS NULL OR NOT contains(text, '\x00')")
    con = duckdb.connect()
    path = str(tmp_path / "d.parquet")
    docs.write.parquet(path)
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text FROM '{path}/*.parquet'")
    assert compare(merkle.fingerprints(docs), con, merkle.ORACLE_SQL) is None


def test_merkle_locates_edits(spark):
    a = "One two three.\nFour five.\n\nSix seven eight nine ten.\n\nLast part here."
    rows = spark.createDataFrame([(a, a.replace("seven", "SEVEN"))], "a string, b string").select(merkle.tree(F.col("a")).alias("x"), merkle.tree(F.col("b")).alias("y"))
    r = rows.select(merkle.differing_sections(F.col("x"), F.col("y")).alias("d"), merkle.likeness(F.col("x"), F.col("y")).alias("l"), merkle.likeness(F.col("x"), F.col("x")).alias("same")).first()
    assert r["d"] == [1] and 0 < r["l"] < 1 and r["same"] == 1


def test_merkle_next_over_blocks(spark):
    ids = [-5000, -3, 0, 1, 1023, 1024, 5000, 2_000_000, 2_000_001, 9_000_000_000]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(df).collect()}
    assert got == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1])}
    assert merkle.fingerprints(empty(spark)).collect() == []
    assert len(merkle.fingerprints(documents(spark)).collect()) == len(texts())


def distance(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to a substring, by the table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_and_matches_equal_the_table():
    r = random.Random(4)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (14, 30))
        assert decontaminate.myers(p, t)[0] == distance(p, t)
    items = [decontaminate.normal(prose(i, 12)) for i in range(6)]
    matcher = decontaminate.Matcher(items, 0.1)
    for _ in range(60):
        k = r.randrange(6)
        t = list(items[k])
        for _ in range(r.randint(0, int(0.15 * len(t)))):
            i = r.randrange(len(t))
            t[i:i + r.randint(0, 1)] = r.choice(["x", "", "yz"])
        text = decontaminate.normal(f"{prose(50, 20)} {''.join(t)} {prose(51, 20)}")
        want = {n: d for n, i in enumerate(items) if (d := distance(i, text)) <= int(0.1 * len(i))}
        found = matcher.find(text)
        assert found.keys() == want.keys() and all(found[n][0] >= want[n] for n in want)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    bench = spark.createDataFrame([(1, prose(1, 20).upper(), 5), (2, "  ", 5), (None, None, 5), (3, prose(60, 25), 5), (4, prose(60, 25), 5), (5, prose(70, 15), 5)], "item_id long, text string, distance int")
    want = {(d, i) for d, t in texts() for i, item in ((1, prose(1, 20)), (3, prose(60, 25)), (4, prose(60, 25)), (5, prose(70, 15)))
            if t and distance(decontaminate.normal(item), decontaminate.normal(t)) <= int(0.08 * len(item))}
    got = decontaminate.matches(documents(spark), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 0
    kept = decontaminate.clean(documents(spark), bench).collect()
    held = [t for _, t in texts() if not t or all(distance(decontaminate.normal(item), decontaminate.normal(t)) > int(0.08 * len(item)) for item in (prose(1, 20), prose(60, 25), prose(70, 15)))]
    assert sorted(str(r["text"]) for r in kept) == sorted(map(str, held)) and len(held) < len(texts()) - 3
    assert decontaminate.matches(empty(spark), bench).collect() == [] and decontaminate.matches(documents(spark), bench.limit(0)).collect() == []
