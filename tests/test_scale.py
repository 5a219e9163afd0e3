"""Steps that must not grow faster than their input, and what they must still give."""
import io
import os
import random
import re
import time
import zipfile
from html.parser import HTMLParser
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from levybook.functions.shared import cut, kept, shared_dir
from levybook.operators import changes, coverage, load, merge, pages
from levybook.plans import all_queries  # noqa: F401
from levybook.plans.fixtures import Tables
from levybook.plans.registry import QUERIES
from levybook.sources import files
from levybook.streaming import jobs


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_item_sources_pair_last(spark):
    """Items meet sources in the last join, so pairs are not shuffled; a tag named twice is one source."""
    items = spark.createDataFrame([("3901", "property"), ("3901", "sales_use"), ("3902", "property"), ("40", "sales_use")], "geoid string, category string")
    places = spark.createDataFrame([("3901", "39", "3901"), ("3902", "39", None), ("40", "40", None)], "geoid string, state_fips string, county_fips string")
    sources = spark.createDataFrame([(1, "39", "a", 1, None), (2, "39", "b", 2, "property,lodging_meals,property"), (3, "3901", "c", 3, "sales_use"), (4, None, "d", 1, None), (5, "40", "e", 1, "property")],
                                    "id long, scope_geoid string, url string, authority_tier int, categories string")
    pages = spark.createDataFrame([("3902", "property"), ("3902", "property")], "geoid string, category string")
    got = coverage.item_sources(items, places, sources, pages)
    assert sorted(tuple(r) for r in got.collect()) == [
        ("3901", "property", "a", 1, 1, 0), ("3901", "property", "b", 2, 1, 0), ("3901", "sales_use", "a", 1, 1, 0), ("3901", "sales_use", "c", 3, 1, 0),
        ("3902", "property", "a", 1, 1, 1), ("3902", "property", "b", 2, 1, 1)]
    top = next(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
    assert re.search(r"\[scope_geoid#\d+, _deal#\d+\]", top)


def test_copies_of_sources_are_not_broadcast(spark):
    """Sources are copied for each deal, which the estimate of their size does not know; the driver would gather all copies."""
    got = QUERIES["j18_item_sources"].build(Tables(spark, "/root/testdata/sf0.001"))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "_deal" in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_rate_lines_are_cut_once(spark):
    """A1: a line is cut once for its nine fields; quoted fields, blanks around and short lines as before."""
    lines = ['39,0,"0,61",0.015,0.015,,0,20200101,99991231', "39,0,061,0.015,0.015,0,0,20200101", ' 39,0,7,1e-2,0.5,0,0,2020-01-01,20211231,more,"x" ', "39,0,8,0.5, ,0,0,,", '39,0,9,"0.25",0.5,0,0,,', "39,0,,,,,,,", '"State",1']
    rows = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "path string, line_no long, line string")
    got = files.parse_numbered_lines(rows)
    assert sorted((r.line_no, r.jfips, r.rate_intra, r.begin_date, r.end_date, r.open_ended) for r in got.collect()) == [
        (0, "0,61", 0.015, "2020-01-01", "9999-12-31", True), (2, "7", 0.01, "2020-01-01", "2021-12-31", False), (4, "9", 0.25, None, None, False), (5, "", None, None, None, False)]
    whole = files.parse_rate_lines(spark.createDataFrame([("p", "\n".join(lines)), ("q", None)], "path string, text string"))
    assert sorted(whole.collect()) == sorted(got.collect())
    assert plan(got).count("from_csv") + plan(got).lower().count("csvtostructs") == 1 and plan(whole).count("\\r\\n|") <= 1


def test_line_numbers_without_a_shuffle_of_lines(spark, tmp_path):
    """A1: lines are numbered where they are read; the name of a file is read once a split."""
    (tmp_path / "OHR2026Q1.csv").write_text("a\nb\n")
    shape = files.rate_lines(spark, str(tmp_path / "OHR2026Q1.csv"))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in shape and "SortMergeJoin" not in shape


def test_small_members_go_together(spark):
    """A2: the lines of many small archives leave Python in few batches, those of a large one in parts."""
    def pack(n):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("a.csv", "".join(f"{k}\n" for k in range(n)))
        return buf.getvalue()
    blobs = spark.createDataFrame([(f"f{i}", pack(3)) for i in range(50)] + [("large", pack(2 * files.MEMBER_LINES + 7)), ("none", pack(0))], "path string, content binary").coalesce(1)
    out = files.member_lines(blobs)
    got = {}
    for r in out.collect():
        got.setdefault(r.path, []).append((r.line_no, r.line))
    assert {k: len(v) for k, v in got.items()} == {f"f{i}": 3 for i in range(50)} | {"large": 2 * files.MEMBER_LINES + 7}
    assert all(sorted(v) == [(k, str(k)) for k in range(len(v))] for v in got.values())

    def sizes(batches):
        for b in batches:
            yield b[["n"]].iloc[:1].assign(n=len(b))
    n = [r.n for r in out.select(F.lit(1).cast("long").alias("n")).mapInPandas(sizes, "n long").collect()]
    assert sum(n) == 150 + 2 * files.MEMBER_LINES + 7 and len(n) <= 5


def test_sections_are_read_once(spark):
    """A section's text is parsed once, not again to test for rows; documents without rows give none."""
    cols = ", ".join(f"{x} string" for x in ("doc_path", "researcher", "retrieved_at", "extraction_method", *files.DOCUMENT, "profile"))
    docs = spark.createDataFrame([("a", "r", "t", "m", '[{"geoid":"1"},{"geoid":"2"}]', None, None, None, None), ("b", "r", "t", "m", "[]", None, None, None, None),
                                  ("c", "r", "t", "m", None, "[]", None, None, None)], cols)
    rows = files.section_rows(files.judge_documents(docs), "findings")
    assert sorted((r.doc_path, r.pos, r.geoid) for r in rows.collect()) == [("a", 0, "1"), ("a", 1, "2")]
    assert plan(rows).count("from_json") == 1


def test_rows_without_a_place_are_spread(spark):
    """E5: rows that can have no geoid do not share one partition of the join with the registry."""
    places = spark.createDataFrame([("39061", "county")], "geoid string, kind string")
    rows = spark.range(4000).selectExpr("'p' AS path", "id AS line_no", "'39' AS state_fips", "CASE WHEN id % 4 = 0 THEN '00' ELSE '45' END AS jtype", "'061' AS jfips")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = changes.map_rate_rows(rows, places)
        assert {(r.reason, r["count"]) for r in got.groupBy("reason").count().collect()} == {(None, 1000), ("state_authority", 3000)}
        parts = [r["count"] for r in got.where("reason = 'state_authority'").groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) > 4 and max(parts) < 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Plainly(pages._Page):
    """The page reader with every tag read by the library, and open tags searched one by one."""
    parse_starttag, parse_endtag, updatepos = HTMLParser.parse_starttag, HTMLParser.parse_endtag, HTMLParser.updatepos

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        start = None
        if at is not None:
            start = self.open[at][1]
            self.closed.add(start)
            for name, _ in self.open[at:]:
                self.n_open[name] -= 1
            del self.open[at:]
        self.events.append(("end", tag, start))


def test_plain_tags_read_alike():
    """L1: tags without attributes take a short way with the same events."""
    rng = random.Random(5)
    bits = ["<p>", "</p>", "<P>", "</P >", "<a href='x'>", "</a>", "<script>", "</script>", "<title>", "</title>", "<textarea>", "</textarea>", "<style>", "</style>", "<br>", "<br/>", "<td>", "</td>", "<x-y>", "</x-y>",
            "text ", "&amp;", "&#65;", "<", ">", "</", "<!-- c -->", "<!doctype html>", "</ p>", "<p", "\n", "<plaintext>", "<noscript>", "</noscript>", "</>", "<h1>", "</h1>"]
    for _ in range(3000):
        html = "".join(rng.choices(bits, k=rng.randint(1, 25)))
        got, want = pages._Page(), Plainly()
        for page in (got, want):
            page.feed(html)
            page.close()
        assert (got.events, got.closed, got.open) == (want.events, want.closed, want.open), html


def test_open_tags_are_not_searched_for_each_end():
    """L1: the time of a page with many tags left open grows with its length."""
    def seconds(n):
        t = time.process_time()
        pages._parse("u", "<p>x" * n + "</b>" * n)
        return time.process_time() - t
    seconds(200)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.002)


def test_claims_are_read_once(spark):
    """The primary citation and the others come out of one list; claims without others, and others without a source or role."""
    held = spark.createDataFrame([("t", "1", "s9", "corroborating", "x", 1)], "claim_table string, claim_id string, source_id string, role string, observed_value string, agrees int")
    claims = spark.createDataFrame([("t", "1", "s1", "q", [("s2", None, "v"), (None, "primary", "w"), ("s9", "corroborating", "z"), ("s3", "conflicting", None)]), ("t", "2", "s1", None, None), ("t", "3", None, "q", [("s4", None, None)])],
                                   "claim_table string, claim_id string, source_id string, source_quote string, corroborating array<struct<source_id:string,role:string,observed_value:string>>")
    got = merge.cite_claims(held, claims)
    assert sorted((r.claim_id, r.source_id, r.role, r.observed_value, r.agrees) for r in got.collect()) == [
        ("1", "s1", "primary", "q", 1), ("1", "s2", "corroborating", "v", 1), ("1", "s3", "conflicting", None, 0), ("2", "s1", "primary", None, 1), ("3", "s4", "corroborating", None, 1)]
    assert "Union" not in plan(got)


def test_pages_are_dealt_before_they_are_written(spark):
    """Made pages go over no shuffle before they are parsed."""
    for name in ("l1_page_text", "l2_page_links", "l11_page_record"):
        lines = plan(QUERIES[name].build(Tables(spark, "/root/testdata/sf0.001"))).splitlines()
        assert not any("Repartition" in x and "html" in x for x in lines)
        assert all("c_custkey" in x for x in lines if "Repartition" in x) and any("Repartition" in x for x in lines)


def test_texts_are_dealt_before_they_are_searched(spark):
    """A table in one split does not keep its text work in one task, and texts are searched once."""
    t = Tables(spark, "/root/testdata/sf0.001")
    hits = plan(pages.statutes_by_category(t.statutes))
    assert hits.index("Generate") < hits.index("RepartitionByExpression [doc_id") and "size(" not in hits
    for name in ("g26_quote_not_archived", "h1_rate_flags"):
        lines = plan(QUERIES[name].build(Tables(spark, "/root/testdata/sf0.001"))).splitlines()
        deal = next(i for i, x in enumerate(lines) if "RepartitionByExpression [archive_file_id" in x)
        assert any("regexp_replace" in x for x in lines[:deal]) and not any("regexp_replace(" in x and "text" in x for x in lines[deal:deal + 2])


def test_history_is_numbered_once(spark):
    """What many steps read is stored in columns, not made of the lines again."""
    for name in ("g27_strict_verdict", "h10_route", "d1_supersede_bare_years"):
        t = Tables(spark, "/root/testdata/sf0.001")
        QUERIES[name].build(t)
        assert "l_shipdate" not in plan(t.numbered) and "kept-numbered" in t.numbered.inputFiles()[0]
        assert "l_shipdate" not in plan(t.rate_history) + plan(t.facts)


def test_arrivals_are_ordered_without_a_comparator(spark):
    """Arrivals of a key come in any order, columns without an order among them; places are sorted natively."""
    n = 200
    rows = [("g", "c", "i", k, f"{1990 + k * 7 % 30}-01-01", None, {"k": str(k)}) for k in random.Random(3).sample(range(1, n + 1), n)]
    df = spark.createDataFrame(rows, "geoid string, category string, instrument_code string, arrival_seq long, effective_date string, fiscal_year long, more map<string,string>")
    got = {r.arrival_seq: r for r in merge.supersede(df, chunk_rows=4).collect()}
    live, by, took = None, {}, set()
    day = {r[3]: r[4] for r in rows}
    for k in range(1, n + 1):
        if live is None or day[k] >= day[live]:
            if live is not None:
                by[live] = k
            live = k
            took.add(k)
        else:
            by[k] = live
    assert {k: (r.became_live, r.superseded_by, r.more["k"]) for k, r in got.items()} == {k: (k in took, by.get(k), str(k)) for k in range(1, n + 1)}
    assert "lambda" not in "".join(re.findall(r"array_sort\(.*", plan(merge._gathered(merge._steps(df, merge.FACT_KEY, "arrival_seq", True), merge.FACT_KEY, "_seq", 4))))


def test_arrivals_are_stored_packed(spark):
    """What several steps read of the arrivals is a packed table, not a checkpoint of texts; columns that nobody asks for stay away."""
    n, rng = 20_000, random.Random(7)
    rows = [(f"g{k % 50}", "c", "i", k // 50 + 1, f"{rng.randint(1990, 2020)}-0{rng.randint(1, 9)}-15", None, f"{k} {rng.random()}") for k in range(n)]
    df = spark.createDataFrame(rows, "geoid string, category string, instrument_code string, arrival_seq long, effective_date string, fiscal_year long, note string")
    size = lambda x: sum(os.path.getsize(urlparse(f).path) for f in x.inputFiles() if "kept-arrivals" in f)
    whole, few = merge.supersede(df, chunk_rows=32), merge.supersede(df, chunk_rows=32, only=[])
    assert 0 < size(few) < 16 * n and size(whole) > size(few) + 8 * n
    assert few.columns == [x for x in whole.columns if x not in ("effective_date", "fiscal_year", "note")]
    assert sorted(few.collect()) == sorted(whole.select(*few.columns).collect())
    assert {(r.geoid, r.arrival_seq): r.note for r in whole.collect()} == {(r[0], r[3]): r[6] for r in rows}


def test_ranks_of_odd_years(spark):
    """Years of any number of digits, below zero too, and days that are no dates, in the order of numbers and then of texts."""
    given = [None, None, (None, -3), (None, 3), (None, 12000), ("12", 7), ("0003-02-01", None), ("1992", None), (None, 1992), ("1992~z", None), ("1992\u5e74", 5), ("1992-06-30T10:00", 1), (None, 1991), (None, 99999), ("9999-12-31", None), (None, 10000)]
    rng = random.Random(11)

    def parts(g):
        day, year = (g or (None, None))
        day = day[:10] if day and re.match("[0-9]{4}", day) else None
        return (int(day[:4]) if day else year), day

    rows, want = [], {}
    for k in range(40):
        live, by, took = None, {}, set()
        for n, g in enumerate(rng.choices(given, k=25), 1):
            rows.append((f"g{k}", "c", "i", n, *(g or (None, None))))
            y, d = parts(g)
            old = live and parts(live[1])
            older = live and y is not None and old[0] is not None and (d.encode() < old[1].encode() if d and old[1] and y == old[0] else y < old[0])
            if older:
                by[n] = live[0]
            else:
                if live:
                    by[live[0]] = n
                live = (n, g)
                took.add(n)
        want |= {(f"g{k}", n): (n in took, by.get(n)) for n in range(1, 26)}
    df = spark.createDataFrame(rows, "geoid string, category string, instrument_code string, arrival_seq long, effective_date string, fiscal_year long")
    for fan in (3, 256):
        assert {(r.geoid, r.arrival_seq): (r.became_live, r.superseded_by) for r in merge.supersede(df, chunk_rows=fan).collect()} == want


def test_a_stream_leaves_its_ledger_only(spark, tmp_path):
    """What a batch stores on its way, the text of its documents above all, is packed and goes when the batch is committed."""
    places = spark.createDataFrame([("0100001", "county", "A County", "OH", 5)], "geoid string, kind string, name string, state_usps string, population long")
    fact = '{"geoid":"0100001","category":"sales_use","instrument_code":"use_tax","status":"levied","rate_value":1.5,"rate_unit":"percent","effective_date":"20%02d-01-01","notes":"' + "x" * 50_000 + \
        '","source":{"url":"https://x.gov","source_type":"portal"},"confidence":"high"}'
    spark.createDataFrame([('{"researcher":"r","findings":[' + fact % k + "]}",) for k in range(10, 30)], "value string").coalesce(1) \
        .write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(str(tmp_path / "in"))
    shared = Path(urlparse(shared_dir(spark)).path)
    before = {x for x in shared.rglob("*") if x.is_file()}
    jobs.load_stream(spark, str(tmp_path / "in"), str(tmp_path / "ledger"), places, str(tmp_path / "state"), 7).awaitTermination()
    facts = jobs.ledger(spark, str(tmp_path / "ledger")).read("facts")
    assert sorted((r.effective_date, r.superseded_by is None, len(r.notes)) for r in facts.collect()) == [(f"20{k}-01-01", k == 29, 50_000) for k in range(10, 30)]
    left = [x for x in shared.rglob("*") if x.is_file() and x not in before]
    assert not any("kept-" in str(x) for x in left) and sum(x.stat().st_size for x in left) < 400_000


def test_stored_steps_drop_their_shuffles(spark, tmp_path):
    """Once rows are stored, packed or as a checkpoint, no shuffle files of theirs stay."""
    spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    for store in (lambda df: kept(df, "probe"), cut):
        rows = spark.range(50_000).selectExpr("id % 7919 AS k", "id").groupBy("k").count()
        held = tracker.shuffleStatuses().size()
        got = store(rows)
        assert tracker.shuffleStatuses().size() <= held and got.count() == 7919


def test_events_in_few_chunks(spark):
    """Totals are taken over quarters, in the order of whatever text the date is, and scanned values are not shuffled."""
    rng = random.Random(13)
    days = [f"199{y}-{m:02d}-{d:02d}" for y in range(3) for m in range(1, 13) for d in (1, 17)] + ["", "1992", "1992-1", "1991-13-01", "x", "1990/07", None]
    rows = [("39", "s", f"i{k % 3}", k, rng.choice([0.01, 0.02, None]), rng.choice(days), rng.random() < .5) for k in range(600)]
    df = spark.createDataFrame(rows, "geoid string, category string, instrument_code string, line_no long, rate_intra double, begin_date string, open_ended boolean")
    got, want, last = changes.rate_events(df), [], {}
    for _, _, tool, n, rate, day, is_open in sorted(rows, key=lambda r: (r[5] or "", r[3])):
        now, old = rate and round(rate * 100, 4), last.get(tool)
        kind = "new" if old is None else ("increase" if (now or 0) > (old[0] or 0) else "decrease") if old[0] != now else "extended" if is_open and not old[1] else None
        if kind:
            want.append((tool, kind, old and old[0], now, day or "", n))
        last[tool] = (now, is_open)
    assert sorted(map(str, want)) == sorted(str((r.instrument_code, r.change_type, r.rate_before, r.rate_after, r.effective_period, r.arrival)) for r in got.collect())
    lines = plan(got).splitlines()
    joined = next(i for i, x in enumerate(lines) if "Join" in x)
    assert any("_v__prev" in x for x in lines[:joined]) and not any("_v__prev" in x for x in lines[joined:])


def test_documents_are_judged_once(spark):
    """Valid rows and errors of a section come out of its stored judgement, measures as they were given."""
    cols = ", ".join(f"{x} string" for x in ("doc_path", "researcher", "retrieved_at", "extraction_method", *files.DOCUMENT, "profile"))
    src = '"source":{"url":"https://x.gov","source_type":"portal"},"confidence":"high"'
    fact = '{"geoid":"%s","category":"sales_use","instrument_code":"use_tax","status":"levied","rate_value":1.5,"rate_unit":"percent","effective_date":"2020-01-01",' + src + "}"
    measure = '[{"geoid":"0100001","election_date":"2021-11-02","measure_id_local":"1","measure_class":"tax_new","outcome":"passed","votes_yes":70,"votes_no":30,' + src + "}]"
    docs = spark.createDataFrame([("a", "r", "t", "m", "[" + fact % "0100001" + "," + fact % "9999999" + "]", None, None, None, None), ("b", "r", "t", "m", None, measure, None, None, None)], cols)
    places = spark.createDataFrame([("0100001", "county", "A County", "OH", 5)], "geoid string, kind string, name string, state_usps string, population long")
    rules_now = spark.createDataFrame([], load.LEDGER["thresholds"][0])
    stored = []
    got = load.check_documents(files.judge_documents(docs), places, rules_now, present=frozenset(("findings", "measures")), keep=lambda rows: stored.append(cut(rows)) or stored[-1])
    assert [(r.doc_path, r.pos) for r in got.valid["findings"].collect()] == [("a", 0)]
    assert [(r.doc_path, r.votes_total, r.pct_yes) for r in got.valid["measures"].collect()] == [("b", None, None)]
    assert [r.error for r in got.errors.collect()] == ["finding[1]: geoid_not_seeded"]
    assert len(stored) == 3 and not any(x in plan(got.valid[s]) for s in ("findings", "measures") for x in ("from_json", "Join"))
