"""Hand rows for the semantics that are easy to get wrong, and brute-force twins."""
import random

import pytest
from pyspark.sql import functions as F

from levybook.functions.scan import Scan, coalescing_upsert, running
from levybook.operators import flags, load, merge, pages, rules, views


def fold(rows):
    """The live row kept one arrival at a time: {seq: (became_live, superseded_by)}."""
    live, out = None, {}
    for seq, eff, fy in rows:
        year = lambda e, f: int(e[:4]) if e else f
        older = False
        if live:
            _, leff, lfy = live
            if eff and leff:
                older = eff[:10] < leff[:10]
            elif year(eff, fy) is not None and year(leff, lfy) is not None:
                older = year(eff, fy) < year(leff, lfy)
        if older:
            out[seq] = [False, live[0]]
        else:
            if live:
                out[live[0]][1] = seq
            out[seq] = [True, None]
            live = (seq, eff, fy)
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize(("seed", "chunk_rows"), [(1, 16), (2, 2), (4, 256)])
def test_supersede_equals_fold(spark, seed, chunk_rows):
    rng, rows, want = random.Random(seed), [], {}
    for k in range(12):
        arr = []
        for seq in range(1, 40 if k else 300):  # one key much larger than the rest
            y = rng.randint(2015, 2019)
            eff = f"{y}-{rng.randint(1, 12):02d}-01" if rng.random() < .5 else None
            arr.append((seq, eff, y if rng.random() < .8 else None))
        want.update({(f"k{k}", s): v for s, v in fold(arr).items()})
        rows += [(f"k{k}", "c", "i", *a) for a in arr]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "geoid string, category string, instrument_code string, arrival_seq long, effective_date string, fiscal_year long")
    got = {(r.geoid, r.arrival_seq): (r.became_live, r.superseded_by) for r in merge.supersede(df, chunk_rows=chunk_rows).collect()}
    assert got == want


def test_supersede_without_rows_and_far_numbers(spark):
    schema = "geoid string, category string, instrument_code string, arrival_seq long, effective_date string, fiscal_year long"
    assert merge.supersede(spark.createDataFrame([], schema)).collect() == []
    rows = [("k", "c", "i", s, None, y) for s, y in ((-5, 2000), (10**9, 1999), (10**9 + 40000, 2001))]
    got = {r.arrival_seq: (r.became_live, r.superseded_by) for r in merge.supersede(spark.createDataFrame(rows, schema), chunk_rows=8).collect()}
    assert got == {-5: (True, 10**9 + 40000), 10**9: (False, -5), 10**9 + 40000: (True, None)}


def test_supersede_dated_path_agrees(spark):
    rng = random.Random(3)
    rows = [("k", "c", "i", s, f"{rng.randint(2000, 2003)}-0{rng.randint(1, 9)}-15", None) for s in range(1, 200)]
    df = spark.createDataFrame(rows, "geoid string, category string, instrument_code string, arrival_seq long, effective_date string, fiscal_year long")
    a = sorted(tuple(r) for r in merge.supersede(df, bare_years=False, chunk_rows=10).collect())
    b = sorted(tuple(r) for r in merge.supersede(df, chunk_rows=50).collect())
    assert a == b


@pytest.mark.parametrize("parts", [1, 7])
def test_running_against_brute_force(spark, parts):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 11}", i, rng.randint(-5, 5) if rng.random() < .8 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, v int").repartition(parts)
    got = running(df, ["k"], F.floor(F.col("i") / 25), ["i"], [
        Scan("mx", "max", F.col("v")), Scan("sm", "sum", F.col("v"), inclusive=False), Scan("lg", "last", F.col("v"), inclusive=False),
        Scan("nx", "min", F.col("i"), inclusive=False, backward=True), Scan("n", "sum", F.lit(1), whole=True)]).collect()
    byk = {}
    for k, i, v in rows:
        byk.setdefault(k, []).append((i, v))
    assert len(got) == 600
    for r in got:
        seen = [v for i, v in byk[r.k] if i <= r.i and v is not None]
        prior = [v for i, v in byk[r.k] if i < r.i and v is not None]
        after = [i for i, _ in byk[r.k] if i > r.i]
        assert r.mx == (max(seen) if seen else None) and r.sm == (sum(prior) if prior else None)
        assert r.lg == (prior[-1] if prior else None) and r.nx == (min(after) if after else None) and r.n == len(byk[r.k])


def test_upsert_never_blanks(spark):
    s = "k string, a int, b string, seq long"
    old = spark.createDataFrame([("x", 1, "old", 0), (None, 5, None, 0)], s)
    new = spark.createDataFrame([("x", None, "new", 1), ("x", 3, None, 2), (None, None, "n", 3), ("y", 9, None, 4)], s)
    assert {tuple(r) for r in coalescing_upsert(old, new, ["k"], ["a", "b"], "seq").collect()} == {("x", 3, "new"), (None, 5, "n"), ("y", 9, None)}


def test_measures_without_id_match_by_title(spark):
    s = "geoid string, election_date string, measure_id_local string, official_title string, pct_yes double, seq long"
    old = spark.createDataFrame([("g", "d", None, "Parks", 50.0, 0), ("g", "d", "Parks", None, 60.0, 1)], s)
    new = spark.createDataFrame([("g", "d", None, "Parks", 51.0, 2), ("g", "d", None, "Fire", 40.0, 3), ("g", "d", "Parks", None, None, 4)], s)
    got = {(r.measure_id_local, r.official_title, r.pct_yes) for r in merge.upsert_measures(old, new).collect()}
    assert got == {(None, "Parks", 51.0), ("Parks", None, 60.0), (None, "Fire", 40.0)}


RULE = "id long, state_usps string, jurisdiction_kind string, measure_class string, instrument_code string, purpose_restriction string, threshold_value double, threshold_basis string, effective_from string, effective_to string"
MEAS = "n long, geoid string, election_date string, measure_class string, instrument_code string, purpose_type string"


def brute_rule(m, kind, rules_):
    pur = [m[5], "either", None] if m[5] in ("general", "special") else ["either", None]
    for k in (kind, None):
        for i in ([m[4], None] if m[4] else [None]):
            for p in pur:
                hit = [r for r in rules_ if r[1] == "OH" and r[3] == m[3] and r[2] == k and r[4] == i and r[5] == p
                       and (r[8] is None or r[8] <= m[2]) and (r[9] is None or r[9] >= m[2])]
                if hit:
                    return max(hit, key=lambda r: (r[8] or "0000", r[0]))[0]
    return None


def test_threshold_resolution_against_brute_force(spark):
    rng = random.Random(9)
    day = lambda: f"{rng.randint(2010, 2015)}-0{rng.randint(1, 9)}-01"
    rl = [(i, "OH", rng.choice(["county", "place", None]), "tax_new", rng.choice(["use_tax", "gross_receipts", None]), rng.choice(["general", "special", "either", None]),
           float(i), "votes_cast", rng.choice([day(), None]), rng.choice([day(), None, None])) for i in range(150)]
    ms = [(i, "39061", day(), "tax_new", rng.choice(["use_tax", "severance", None]), rng.choice(["general", "special", "other", None])) for i in range(200)]
    places = spark.createDataFrame([("39061", "OH", "county")], "geoid string, state_usps string, kind string")
    got = {r.n: r.rule_id for r in merge.resolve_thresholds(spark.createDataFrame(ms, MEAS), places, spark.createDataFrame(rl, RULE)).collect()}
    assert got == {m[0]: brute_rule(m, "county", rl) for m in ms}


GRANT = "id long, state_usps string, jurisdiction_kind string, category string, instrument_code string, permitted string, max_rate double, max_rate_unit string, stacking_rule string, statute_cite string, effective_from string, effective_to string"


def test_headroom_overlap_revocation_and_future(spark):
    g = lambda i, kind, code, perm, rate, frm: (i, "OH", kind, "sales_use", code, perm, rate, "percent", None, "c", frm, None)
    grants = spark.createDataFrame([g(1, None, "use_tax", "yes", 3.0, "1990-01-01"), g(2, None, "use_tax", "yes", 3.0, "2010-01-01"), g(3, "place", "use_tax", "yes", 3.0, "2015-01-01"),
                                    g(4, None, "gross_receipts", "yes", 2.0, "1990-01-01"), g(5, None, "gross_receipts", "no", None, "2000-01-01"), g(6, None, "sales_tax_cap", "yes", 1.0, "2000-01-01"),
                                    g(7, None, "sales_tax_cap", "yes", 9.0, "2090-01-01")], GRANT)
    places = spark.createDataFrame([("3915000", "C", "OH", "place", 5)], "geoid string, name string, state_usps string, kind string, population long")
    facts = spark.createDataFrame([("3915000", "use_tax", "levied", 1.25, "percent", None), ("3915000", "use_tax", "levied", 4.0, "mills", None)],
                                  "geoid string, instrument_code string, status string, rate_value double, rate_unit string, superseded_by string")
    got = {r.instrument_code: (r.grant_id, r.levied_rate, r.headroom) for r in views.headroom(places, grants, facts, "2026-01-01").collect()}
    assert got == {"use_tax": (3, 1.25, 1.75), "sales_tax_cap": (6, 0.0, 1.0)}


def test_sunset_dates(spark):
    facts = spark.createDataFrame([("g", "c", "i1", "levied", 1.0, "percent", "6/30/2027", None), ("g", "c", "i2", "levied", 1.0, "percent", "2027-08-01", None), ("g", "c", "i3", "levied", 1.0, "percent", "2027-02-31", None)],
                                  "geoid string, category string, instrument_code string, status string, rate_value double, rate_unit string, expiration_date string, superseded_by string")
    places = spark.createDataFrame([("g", "n", "place", "OH", 1)], "geoid string, name string, kind string, state_usps string, population long")
    ms = spark.createDataFrame([("g", "levy_override", "passed", 61.0, 5), ("g", "advisory", "passed", 90.0, None)], "geoid string, measure_class string, outcome string, pct_yes double, superseded_by long")
    got = {r.instrument_code: (r.days_out, r.prior_revenue_measures, r.best_prior_yes) for r in views.sunset_watch(facts, places, ms, "2027-01-01").collect()}
    assert got == {"i2": (212, 0, 61.0), "i3": (61, 0, 61.0)}


def test_iso_shape_and_profile(spark):
    df = spark.createDataFrame([("2027-02-31",), ("1799-01-01",), ("2027-13-01",), ("6/30/2027",), ("2027-01-01T00:00",), (None,)], "d string")
    assert [r.iso_shaped for r in rules.iso_date_flag(df, "d").collect()] == [True, False, False, False, True, False]


def test_excerpt(spark):
    text = "h" * 9000 + "ANCHOR one" + "x" * 9000 + "ANCHOR two" + "t" * 9000
    df = spark.createDataFrame([(1, text, ["ANCHOR one", "ANCHOR two", "zz"]), (2, text, ["nothing here"]), (3, "short", ["short"])], "id int, text string, a array<string>")
    got = {r.id: r.e for r in df.select("id", flags.excerpt(F.col("text"), F.col("a"), 20000).alias("e")).collect()}
    sep = "\n\n[... document trimmed to the passages around each finding ...]\n\n"
    p1, p2 = text.find("ANCHOR one"), text.find("ANCHOR two")
    assert got[1] == sep.join([text[:3000], text[p1 - 2000:p1 + 2010], text[p2 - 2000:p2 + 2010]])
    assert got[2] == text[:20000] and got[3] == "short"


def test_pages(spark):
    html = ("<html><head><title>Tax rates</title><script>var x='tax'</script></head><body><nav><a href='/home'>Home</a></nav><h1>Levy</h1>"
            "<table><tr><th>Unit</th><th>Mills</th></tr><tr><td>City</td><td>2.5</td></tr></table><p>Read <a href='rates.pdf#p2'>the rates</a> or <a href='mailto:x@y'>mail</a></p><footer>bye</footer></body></html>")
    parsed = pages.parse_pages(spark.createDataFrame([(1, "https://x.gov/tax/", html)], "page_id long, url string, html string"))
    row = parsed.first()
    assert row.title == "Tax rates" and "Unit | Mills\nCity | 2.5" in row.text and "bye" not in row.text and "Home" not in row.text and "var x" not in row.text
    links = [(r.href, r.anchor) for r in pages.explode_links(parsed).collect()]
    assert ("https://x.gov/tax/rates.pdf", "the rates") in links and all(h.startswith("https://") for h, _ in links)


def test_an_unclosed_form_drops_nothing(spark):
    html = "<div><form><input><p>Rate 5 percent</p><table><tr><td>City<td>2.5</table></div><nav>Menu</nav><form>gone</form>" + "<table><tr><td>x</td></tr></table>" * 20
    text = pages.parse_pages(spark.createDataFrame([(1, "https://x.gov/", html), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert "Rate 5 percent" in text[0].text and "City | 2.5" in text[0].text and "Menu" not in text[0].text and "gone" not in text[0].text
    assert text[0].text.split("TABLES:")[1].split("\n\nRate")[0].count("\n\n") == 20 and text[1].text == ""


def test_combine_texts_hot_item(spark):
    rows = [("g", "c", i % 5 == 0, i, f"s{i}", f"text {i} " * 30, f"https://x/{i}", f"t{i}" if i % 3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "geoid string, category string, is_document boolean, page_order long, sha256 string, text string, url string, title string").repartition(5)
    got = pages.combine_texts(df, 5000).first().combined
    full = "\n\n-----\n\n".join(f"URL: {r[6]}\n" + (f"TITLE: {r[7]}\n" if r[7] else "") + r[5] for r in sorted(rows, key=lambda r: (not r[2], r[3])))
    assert got == full[:5000] + "\n\n[truncated]"


def test_merge_findings_keeps_history(spark):
    held = spark.createDataFrame([("a", "g", "c", "i", "2020-01-01", None, 1.0, None), ("z", "g", "c", "i", "2010-01-01", None, 0.5, "a")],
                                 "id string, geoid string, category string, instrument_code string, effective_date string, fiscal_year long, rate_value double, superseded_by string")
    new = spark.createDataFrame([("d1", 0, "g", "c", "i", "2015-01-01", None, 0.7), ("d1", 1, "g", "c", "i", "2022-01-01", None, 2.0)],
                                "doc_path string, pos int, geoid string, category string, instrument_code string, effective_date string, fiscal_year long, rate_value double")
    got = {r.id: r.superseded_by for r in load.merge_findings(held, new).collect()}
    assert got == {"z": "a", "a": "d1#1", "d1#0": "a", "d1#1": None}
