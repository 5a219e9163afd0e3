"""File readers on small files of the published layouts."""
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from levybook.operators import changes, load, spine
from levybook.sources import archive, files

RATES = "\n".join([
    "state,type,code,x",
    "39,0,061,0.01500,0.01500,0.01500,0,20200101,99991231",
    "39,00,061,0.01250,0.01250,0.01250,0,20150101,20191231",
    "",
    "39,01,15000,1.75,1.75,0,0,20210101,20991231",
    "39,45,39,0.05750,0.05750,,0,20130901,99991231",
    "39,63,70010,0.005,0.005,0.005,0,20200101,99991231",
    "39,05,12345,0.005,0.005,0.005,0,20200101,99991231",
    "39,00,999,0.01,bad,0.01,0,20200101,99991231",
    "39,00,777,,0.01,0.01,0,20200101,99991231",
    "39,00",
])


@pytest.fixture(scope="module")
def places(spark):
    rows = [("39", "state", "Ohio", "OH", "39", 100), ("39061", "county", "Hamilton County", "OH", "39", 800), ("3915000", "place", "Cincinnati city", "OH", "39", 300)]
    return spark.createDataFrame(rows, "geoid string, kind string, name string, state_usps string, state_fips string, population long")


def test_rate_lines(spark, tmp_path):
    (tmp_path / "OHR2026Q3x.csv").write_text(RATES)
    rows = files.parse_rate_lines(files.decode_rate_files(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [r.jfips for r in rows] == ["061", "061", "15000", "39", "70010", "12345", "777"]
    assert rows[0].jtype == "00" and rows[0].begin_date == "2020-01-01" and rows[0].end_date == "9999-12-31" and rows[0].open_ended
    assert rows[1].end_date == "2019-12-31" and not rows[1].open_ended
    assert rows[-1].rate_intra is None and rows[-1].rate_inter == 0.01


def test_zip_and_plain_decode(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("readme.md", "no")
        z.writestr("d/OHR.TXT", "caf\xe9".encode("latin-1"))
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    (tmp_path / "b.csv").write_bytes("caf\xe9".encode("latin-1"))
    assert [r.text for r in files.decode_rate_files(spark, str(tmp_path)).collect()] == ["caf\xe9", "caf\xe9"]


def test_listing(spark, tmp_path):
    (tmp_path / "x.html").write_text('<a href="/r/OHR2025Q4a.csv">1</a><a href=OHR2026Q1b.zip>2</a><A HREF="/b/OHB2026Q2.csv">3</A><a href="INR2020Q1.csv">4</a>')
    got = {r.state: r.filename for r in files.latest_rate_files(files.listing_entries(spark, str(tmp_path))).collect()}
    assert got == {"OH": "OHR2026Q1b.zip", "IN": "INR2020Q1.csv"}


def test_rate_load(spark, tmp_path, places):
    (tmp_path / "OHR2026Q3x.csv").write_text(RATES)
    (tmp_path / "OHR2026Q2x.csv").write_text(RATES.replace("0.01500", "0.09000"))
    found, events, out = load.load_rate_files(spark, str(tmp_path), places, "2026-07-01")
    f = {r.geoid: r for r in found.collect()}
    assert set(f) == {"39061", "3915000"}
    assert f["39061"].rate_value == 1.5 and f["39061"].expiration_date is None and f["39061"].source_quote == "0.01500" and f["39061"].confidence == "high"
    assert f["3915000"].rate_value == 1.75 and "Food rate differs." in f["3915000"].notes and f["3915000"].extraction_method == "bulk_import"
    ev = {(r.geoid, r.change_type, r.effective_period) for r in events.collect()}
    assert ev == {("39061", "new", "2015-01-01"), ("39061", "increase", "2020-01-01"), ("3915000", "new", "2021-01-01")}
    assert {(r.raw_key, r.reason) for r in out.collect()} == {
        ("39/45/39", "state_authority"), ("39/63/70010", "special_district"), ("39/05/12345", "township_without_county"), ("39777", "no_such_place")}
    assert [p.rsplit("/", 1)[1] for p in load.newest_rate_files(spark, str(tmp_path))] == ["OHR2026Q3x.csv"]
    held = spark.createDataFrame([("old", "39061", "sales_use", f["39061"].instrument_code, "2001-01-01", None, 1.0, "bulk_import", None)],
                                 "id string, geoid string, category string, instrument_code string, effective_date string, fiscal_year long, rate_value double, extraction_method string, superseded_by string")
    cited = spark.createDataFrame([], "claim_table string, claim_id string, source_id string, role string, observed_value string, agrees int")
    known = spark.createDataFrame([("39061", "sales_use", f["39061"].instrument_code, "new", "2015-01-01")], "geoid string, category string, instrument_code string, change_type string, effective_period string")
    assert {r.source_url.rsplit("/", 1)[1] for r in f.values()} == {"OHR2026Q3x.csv"}
    got = load.load_rates(spark, str(tmp_path), places, "2026-07-01", held, cited, known)
    live = {r.geoid: r.rate_value for r in got.facts.collect() if r.superseded_by is None}
    assert live == {"39061": 1.5, "3915000": 1.75} and {r.id for r in got.facts.collect() if r.superseded_by} == {"old"}
    assert {(r.geoid, r.status) for r in got.items.collect()} == {("39061", "complete"), ("3915000", "complete")}
    assert got.citations.count() == 2 and {(r.geoid, r.change_type) for r in got.events.collect()} == {("39061", "increase"), ("3915000", "new")}


@pytest.fixture(params=["1g", "400b"])
def splits(spark, request):
    """Reads files whole, and in splits of 400 bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, request.param)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_over_splits(spark, tmp_path, splits):
    """Plain files, a zipped one and a folder of parts: the same numbers, whatever the splits and line ends."""
    lines = [f"39,0,{k:03},0.0150,0.0150,0,0,2020{k % 12 + 1:02}01,99991231" + " " * (k % 7) for k in range(90)]
    lines[5:5] = ["", "caf\xe9", "State,x"]
    for name, end in (("OHR2026Q1.csv", "\n"), ("INR2026Q1a.TXT", "\r\n"), ("KSR2026Q1.csv", "\r")):
        (tmp_path / name).write_bytes(end.join(lines).encode("latin-1") + (end.encode() if end == "\n" else b""))
    (tmp_path / "NDR2026Q1").mkdir()
    for k in range(3):
        (tmp_path / "NDR2026Q1" / f"part-0000{k}.txt").write_bytes("\n".join(lines[k * 31:(k + 1) * 31]).encode("latin-1") + b"\n")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("readme.md", "no")
        z.writestr("d/x.csv", "\r\n".join(lines).encode("latin-1"))
    (tmp_path / "WIR2026Q1.zip").write_bytes(buf.getvalue())
    (tmp_path / "notes.md").write_text("39,0,001")
    chosen = load.newest_rate_files(spark, str(tmp_path))
    assert sorted(x.rsplit("/", 1)[1] for x in chosen) == ["INR2026Q1a.TXT", "KSR2026Q1.csv", "NDR2026Q1", "OHR2026Q1.csv", "WIR2026Q1.zip"]
    scan = files.rate_lines(spark, chosen)
    if splits != "1g":
        assert spark.read.text(chosen, pathGlobFilter=files.PLAIN).rdd.getNumPartitions() > 20
    got = {}
    for r in scan.collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["line_no"], r["line"]))
    assert set(got) == {x.rsplit("/", 1)[1] for x in chosen}
    assert all(sorted(x) == list(enumerate(lines)) for x in got.values())
    whole = files.parse_rate_lines(files.decode_rate_files(spark, str(tmp_path / "OHR2026Q1.csv"))).drop("path").collect()
    assert sorted(files.parse_numbered_lines(scan.where(F.col("path").endswith("OHR2026Q1.csv"))).drop("path").collect()) == sorted(whole)
    assert files.rate_lines(spark, [str(tmp_path / "WIR2026Q1.zip")]).count() == len(lines) and files.rate_lines(spark, [str(tmp_path / "OHR2026Q1.csv")]).count() == len(lines)


def test_a_large_member_is_read_as_a_stream(spark, tmp_path):
    """The lines of a member come in parts; no text of 30 MB is put together."""
    import tracemalloc
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", b"39,0,061,0.015,0.015,0,0,20200101,99991231\n" * 700_000)
    tracemalloc.start()
    with files._open_member(buf.getvalue()) as text:
        n = sum(1 for _ in text)
    assert n == 700_000 and tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_later_rows_win_whatever_the_splits(spark, tmp_path, splits):
    """A5, A7 and A8 take the last or first of rows that repeat a key over several splits and files."""
    unit = lambda i, n: f"{i:012}{n:64}{'HAMILTON':35}{'15000':5}"
    (tmp_path / "pid").mkdir()
    for part in range(2):
        (tmp_path / "pid" / f"{part}.txt").write_text("\n".join(unit(k % 7, f"NAME {part} {k}") for k in range(40)))
    got = {r.unit_id: r.name for r in files.finance_directory(spark, str(tmp_path / "pid")).collect()}
    assert got == {f"{i:012}": f"NAME 1 {max(k for k in range(40) if k % 7 == i)}" for i in range(7)}
    (tmp_path / "c.csv").write_text("SUMLEV,STATE,COUNTY,POPESTIMATE2024\n" + "".join(f"050,39,{k % 5:03},{k}\n" for k in range(200)))
    (tmp_path / "s.csv").write_text("SUMLEV,STATE,COUNTY,PLACE,COUSUB,POPESTIMATE2024\n" + "".join(f"162,39,000,{k % 3:05},00000,{k}\n" for k in range(200)))
    pops = {r.geoid: r.population for r in files.populations(spark, str(tmp_path / "c.csv"), str(tmp_path / "s.csv"), 2024).collect()}
    assert pops == {f"39{i:03}": 195 + i for i in range(5)} | {f"39{i:05}": max(k for k in range(200) if k % 3 == i) for i in range(3)}
    cols = "citation string, section_title string, act_status string, text string, source_url string, last_amended_year string"
    spark.createDataFrame([(str(k % 9), "t", "a", f"text {k}", "u", "1999") for k in range(300)], cols).coalesce(1).sortWithinPartitions(F.expr("cast(substr(text, 6) as int)")) \
        .write.option("parquet.block.size", 1024).parquet(str(tmp_path / "oh"))
    first = files.first_per_citation(files.statute_file(spark, str(tmp_path / "oh"), "oh", "v1")).collect()
    assert {(r.citation, r.text) for r in first} == {(str(i), f"text {i}") for i in range(9)}


def test_finance_files(spark, tmp_path, places):
    rec = lambda i, item, amt: f"{i:12}{item:3}{amt:>12}2022 "
    (tmp_path / "dat.txt").write_text("\n".join([rec("361061000000", "T01", "1234"), rec("362061000001", "T09", ""), rec("362061000002", "T09", "x9"), "short"]))
    line = lambda i, n, p: f"{i:12}{n:64}{'HAMILTON':35}{p:5}"
    (tmp_path / "pid.txt").write_text("\n".join([line("361061000000", "HAMILTON COUNTY", "00000"), line("362061000001", "CINCINNATI", "15000"), "short"]))
    got = spine.finance_geoid(files.finance_records(spark, str(tmp_path / "dat.txt")), files.finance_directory(spark, str(tmp_path / "pid.txt")), places, spark)
    assert {(r.unit_id, r.geoid, r.amount_thousands) for r in got.collect()} == {("361061000000", "39061", 1234), ("362061000001", "3915000", 0)}


def test_gazetteer_and_populations(spark, tmp_path):
    (tmp_path / "g.txt").write_bytes("GEOID |USPS|NAME   |FUNCSTAT |ALAND_SQMI\n3915000| OH|Cincinnati city |A|77.9\n3999999|OH|Nowhere CDP|S|\n".encode("latin-1"))
    gaz = files.gazetteer(spark, str(tmp_path / "g.txt"), "place")
    (tmp_path / "c.csv").write_text("SUMLEV,STATE,COUNTY,POPESTIMATE2024\n040,39,000,11000000\n050,39,061,830000\n")
    (tmp_path / "s.csv").write_text("SUMLEV,STATE,COUNTY,PLACE,COUSUB,POPESTIMATE2024\n162,39,000,15000,00000,1\n162,39,000,15000,00000,311000\n061,39,061,00000,12345,9\n170,39,000,77000,00000,A\n157,39,061,15000,00000,5\n")
    pops = files.populations(spark, str(tmp_path / "c.csv"), str(tmp_path / "s.csv"), 2024)
    assert {(r.geoid, r.population) for r in pops.collect()} == {("39", 11000000), ("39061", 830000), ("3915000", 311000), ("3906112345", 9)}
    built = spine.build_places(gaz, pops).collect()
    assert [(r.geoid, r.name, r.population, r.parent_geoid) for r in built] == [("3915000", "Cincinnati city", 311000, "39")]


def test_statute_slice(spark, tmp_path):
    cols = "citation string, section_title string, act_status string, text string, source_url string, last_amended_year string, extra string"
    spark.createDataFrame([("1", "t", "a", "old", "u", "1999", "x"), ("1", "t", "a", "dup", "u", "bad", "x"), (None, "t", "a", "n1", "u", None, "x"), (None, "t", "a", "n2", "u", None, "x")], cols).coalesce(1).write.parquet(str(tmp_path / "oh"))
    rows = files.first_per_citation(files.statute_file(spark, str(tmp_path / "oh"), "oh", "v1")).drop("arrival_seq")
    out = str(tmp_path / "statutes")
    files.replace_slice(rows, out)
    files.replace_slice(rows.withColumn("state_usps", F.lit("IN")), out)
    files.replace_slice(rows.where("text = 'old'"), out)
    assert {(r.state_usps, r.text) for r in spark.read.parquet(out).collect()} == {("OH", "old"), ("IN", "old"), ("IN", "n1"), ("IN", "n2")}


def test_documents(spark, tmp_path, places):
    src = {"url": "https://codes.ohio.gov/x", "source_type": "statute"}
    good = {"geoid": "39061", "category": "sales_use", "instrument_code": "use_tax", "status": "levied", "rate_value": 1.25, "rate_unit": "percent", "confidence": "high", "source": src}
    (tmp_path / "a.json").write_text(json.dumps({"researcher": "r", "findings": [good, {**good, "rate_value": 125}], "thresholds": [
        {"state_usps": "oh", "measure_class": "tax_new", "threshold_value": 0.5, "threshold_basis": "votes_cast", "statute_cite": "c", "confidence": "high", "source": src}]}))
    (tmp_path / "b.json").write_text(json.dumps({"findings": {"not": "a list"}}))
    (tmp_path / "c.json").write_text(json.dumps({"note": 1}))
    (tmp_path / "d.json").write_text(json.dumps({"profile": [{"state_usps": "OH", "home_rule_doctrine": "dillon"}, {"state_usps": "OH", "mayor": "x"}]}))
    docs = files.read_documents(spark, str(tmp_path))
    assert sorted(r.refused for r in docs.where("refused is not null").collect()) == ["findings_not_an_array", "no_section"]
    got = load.check_documents(docs, places)
    assert {r.error for r in got.errors.collect()} == {"finding[1]: percent_out_of_range", "threshold[0]: threshold_is_a_fraction",
                                                       "profile[1]: unknown_fields mayor", "findings_not_an_array", "no_section"}
    assert [(r.rate_value, r.researcher, r.authority_tier) for r in got.valid["findings"].collect()] == [(1.25, "r", 1)]
    assert {(r.section, r.valid, r.rejected, r.written) for r in got.report.collect()} == {("findings", 1, 1, 1), ("thresholds", 0, 1, 0), ("profile", 1, 1, 1)}
    with pytest.raises(ValueError):
        load.check_documents(docs, places, strict=True)


def test_archive(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "u", "Q1", "s1"), (2, "a", "u", "Q1", "s1"), (3, "a", "u", "Q1", "s2"), (4, "a", "u", "Q1", "s1"), (5, "a", "u", "Q2", "s1")],
                                 "arrival_seq long, adapter string, url string, period_label string, sha string")
    out = archive.archive_rows(rows)
    assert {(r.label, r.sha, r.arrival_seq) for r in out.collect()} == {("Q1", "s1", 1), ("Q1@s2", "s2", 3), ("Q2", "s1", 5)}
    held = spark.createDataFrame([("a", "u", "Q1", "s2")], "adapter string, url string, period_label string, sha string")
    assert {(r.label, r.sha) for r in archive.archive_rows(rows, held).collect()} == {("Q1@s1", "s1"), ("Q2", "s1")}
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert archive.archive_arrivals(spark, str(tmp_path), "x", "Q1").first().sha.startswith("ba7816bf")


def test_exports(spark, tmp_path):
    archive.write_exports({"taxes": spark.createDataFrame([(1, "x")], "a int, b string")}, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out" / "taxes"), header=True).first().b == "x"


def test_ad_hoc_json(spark):
    df = archive.ask(spark, {"tt": spark.range(5)}, "SELECT id FROM {tt} ORDER BY id", 2, as_json=True)
    assert [r.json for r in df.collect()] == ['{"id":0}', '{"id":1}']
    for statement in ("DROP TABLE x", "INSERT INTO {tt} VALUES (1)", "SELECT 1) AS a; DROP TABLE x --"):
        with pytest.raises(Exception):
            archive.ask(spark, {"tt": spark.range(5)}, statement)
    assert not spark.catalog.listTables()


def test_event_edges(spark):
    rows = spark.createDataFrame([("g", "s", "i", 1, 0.01, "2020-01-01", "2020-12-31", False), ("g", "s", "i", 2, 0.01, "2021-01-01", "9999-12-31", True), ("h", "s", "i", 1, None, None, "2019-01-01", False)],
                                 "geoid string, category string, instrument_code string, line_no long, rate_intra double, begin_date string, end_date string, open_ended boolean")
    ev = {(r.geoid, r.change_type, r.rate_before, r.rate_after, r.effective_period) for r in changes.rate_events(rows).collect()}
    assert ev == {("g", "new", None, 1.0, "2020-01-01"), ("g", "extended", 1.0, 1.0, "2021-01-01"), ("h", "new", None, None, "")}
    none = spark.createDataFrame([], "geoid string, category string, instrument_code string, change_type string, effective_period string")
    kept = changes.store_events(none, changes.rate_events(rows)).collect()
    assert {r.geoid for r in kept} == {"g"}
    assert [r.effective_period for r in changes.expired_events(rows, "2020-01-01").collect()] == ["2019-01-01"]
