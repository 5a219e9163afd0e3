"""File sources (A1-A9): every reader is a Spark scan with an explicit schema."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scan import first_rows, latest

c = F.col
QUARTER_FILE = r"(?i)([A-Z]{2})R(\d{4}Q[1-4])"


def iso_from_compact(raw: Column) -> Column:
    """YYYYMMDD (any punctuation) to ISO; years 9999 mean open-ended; anything else null."""
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", "")
    day = lambda d: F.when(F.length(d) == 8, F.when(d.startswith("9999"), "9999-12-31").otherwise(
        F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))))
    return F.transform(F.array(digits), day)[0]   # the digits are looked for once


#: Names of rate files, plain and zipped, as the readers' file filters.
PLAIN, ZIPPED = "*.{csv,CSV,txt,TXT}", "*.{zip,ZIP}"
LINE_END = "\r\n|\r|\n"
#: Lines of a zipped member that go to the JVM at a time.
MEMBER_LINES = 5_000


def positioned(scan: DataFrame) -> DataFrame:
    """A file scan with ``_at``, the place of each row: its file, the first byte of its split, and the order within.

    A split is read by one task in order, so the running id rises in it; splits are in
    order of their first bytes. So ``_at`` orders rows alike, however a scan is split.
    """
    return scan.select("*", F.struct(c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"),
                                     F.monotonically_increasing_id().alias("row")).alias("_at"))


def rate_unit(path: Column) -> Column:
    """The rate file that a path belongs to: the last part of it that names a state and quarter, be it a file or a folder of part files."""
    named = F.regexp_extract(path, rf"^(.*{QUARTER_FILE}[^/]*)", 1)
    return F.when(named != "", named).otherwise(path)


def rate_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A1, A2: the lines of rate files as (path, line_no, line), counted from 0 in each file.

    Plain files (csv, txt) are split by bytes over tasks, so one of any size is read by
    many; lines before a split are counted first. Zipped ones are read member by member
    as a stream: only the packed bytes are held. Files may come as folders of parts.
    """
    rows = positioned(spark.read.text(path, pathGlobFilter=PLAIN)).select("_at.*", F.decode(c("value").cast("binary"), "ISO-8859-1").alias("line"))
    split = ["file", "block"]
    before = Window.partitionBy("path").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*split).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("path", rate_unit(c("file")))
    starts = counts.select(*split, "path", (F.coalesce(F.sum("n").over(before), F.lit(0)) - c("first")).alias("shift"))
    # one row a split, of which the driver makes a task each: lines stay where they are read
    plain = rows.join(F.broadcast(starts), split).select("path", (c("row") + c("shift")).alias("line_no"), "line")
    packed = spark.read.format("binaryFile").option("pathGlobFilter", ZIPPED).load(path)
    return plain.unionByName(member_lines(packed))


def member_lines(blobs: DataFrame) -> DataFrame:
    """A2: (path, content) of archives as the numbered lines of each one's first csv or txt member; what is no archive is read as it is."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, at, held = [], [], []   # lines of several small members go together
        for b in batches:
            for path, blob in zip(b["path"], b["content"]):
                with _open_member(blob) as text:
                    lines = enumerate(text)
                    while some := list(islice(lines, MEMBER_LINES)):
                        paths += [path] * len(some)
                        at += [n for n, _ in some]
                        held += [x.removesuffix("\n") for _, x in some]
                        if len(held) >= MEMBER_LINES:
                            yield pd.DataFrame({"path": paths, "line_no": at, "line": held})
                            paths, at, held = [], [], []
        if held:
            yield pd.DataFrame({"path": paths, "line_no": at, "line": held})
    return blobs.select("path", "content").mapInPandas(run, "path string, line_no long, line string")


def _open_member(blob: bytes) -> io.TextIOWrapper:
    raw = io.BytesIO(blob)
    if blob[:2] == b"PK":
        z = zipfile.ZipFile(raw)
        names = [n for n in z.namelist() if n.lower().endswith((".csv", ".txt"))]
        raw = z.open(names[0]) if names else io.BytesIO()
    return io.TextIOWrapper(raw, "latin-1")   # every line end is read as a line feed


def decode_rate_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A2: rate files in a folder, plain or zipped (first csv/txt member), as whole texts (path, text); ``rate_lines`` reads them of any size."""
    return first_members(spark.read.format("binaryFile").load(path))


def first_members(blobs: DataFrame) -> DataFrame:
    """A2: (path, content) as (path, text); one file is decoded at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [_first_member(x) for x in b["content"]]})
    return blobs.select("path", "content").mapInPandas(run, "path string, text string")


def _first_member(blob: bytes) -> str:
    if blob[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(blob)) as z:
            names = [n for n in z.namelist() if n.lower().endswith((".csv", ".txt"))]
            blob = z.read(names[0]) if names else b""
    return blob.decode("latin-1")


def parse_rate_lines(files: DataFrame) -> DataFrame:
    """A1: rate lines of whole texts (path, text), numbered in file order."""
    # outer, as Spark would cut each text again to test for lines; a text that is null has none either way
    return parse_numbered_lines(files.select("path", F.posexplode_outer(F.split("text", LINE_END)).alias("line_no", "line")))


def parse_numbered_lines(lines: DataFrame) -> DataFrame:
    """A1: headerless rate lines (path, line_no, line), read.

    Lines that are blank, start with "state", have fewer than nine fields, a state
    code longer than two digits, or a number that does not parse are left out.
    """
    lines = lines.withColumn("line", F.trim("line")).where((c("line") != "") & ~F.lower("line").startswith("state"))
    names = ["f_state", "f_type", "f_code", "f_intra", "f_inter", "f_food", "f_drug", "f_begin", "f_end"]
    read = F.from_csv("line", ", ".join(f"{n} string" for n in names), {"mode": "PERMISSIVE"})
    # exploded, so that a line is cut once for all its fields; without a quote its commas are the cuts
    cells = lambda r: F.array(*[r[n] for n in names])
    quoted = F.when(F.size(F.split(F.regexp_replace("line", '"[^"]*"', "q"), ",")) >= 9, F.transform(F.array(read), cells)[0])
    parsed = lines.select("path", "line_no", F.explode(F.array(F.when(c("line").contains('"'), quoted).otherwise(F.split("line", ",")))).alias("_f"))
    parsed = parsed.where(F.size("_f") >= 9).select("path", "line_no", *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    pad2 = lambda x: F.lpad(x, F.greatest(F.length(x), F.lit(2)), "0")
    digits = lambda x: F.regexp_replace(F.coalesce(c(x), F.lit("")), r"\D", "")
    num = {k: F.trim(c(f"f_{k}")).try_cast("double") for k in ("intra", "inter", "food")}
    ok = None
    for k in num:
        good = F.coalesce(c(f"f_{k}"), F.lit("")).isin("") | num[k].isNotNull()
        ok = good if ok is None else ok & good
    short = ~F.coalesce("f_state", F.lit("")).rlike(r"\d\D*\d\D*\d")   # told from the field as it stands, as filters repeat what they look at
    return parsed.where(ok & short).select(
        "path", c("line_no").cast("long").alias("line_no"), pad2(digits("f_state")).alias("state_fips"),
        pad2(digits("f_type")).alias("jtype"), F.trim(F.coalesce("f_code", F.lit(""))).alias("jfips"),
        *[num[k].alias(f"rate_{k}") for k in num],
        iso_from_compact(c("f_begin")).alias("begin_date"), iso_from_compact(c("f_end")).alias("end_date"),
        F.trim(F.coalesce("f_end", F.lit(""))).startswith("9999").alias("open_ended"))


def rate_file_name(df: DataFrame, name: str = "filename") -> DataFrame:
    """Adds state and period from a file name like 'OHR2026Q3...'; names without them are dropped."""
    return df.withColumn("state", F.upper(F.regexp_extract(name, QUARTER_FILE, 1))) \
        .withColumn("period", F.upper(F.regexp_extract(name, QUARTER_FILE, 2))).where(c("state") != "")


def latest_rate_files(listing: DataFrame) -> DataFrame:
    """A3: the newest quarter's file per state; the later listing entry wins a tie."""
    named = rate_file_name(listing)
    return latest(named, ["state"], [c("period"), c("pos")], ["period", "filename"])


def listing_entries(spark: SparkSession, path: str) -> DataFrame:
    """A3: csv and zip links of saved directory listings, in order."""
    pages = spark.read.text(path, wholetext=True)
    hrefs = F.regexp_extract_all("value", F.lit(r"""(?i)href=["']?([^"'>\s]+\.(?:csv|zip))"""), 1)
    return pages.select(F.posexplode(hrefs).alias("pos", "url")).withColumn("filename", F.regexp_extract("url", "([^/]*)$", 1))


def finance_records(spark: SparkSession, path: str) -> DataFrame:
    """A4: a finance file."""
    return parse_finance_lines(spark.read.text(path))


def parse_finance_lines(lines: DataFrame) -> DataFrame:
    """A4: 32-character finance lines; short lines and unreadable amounts are left out."""
    raw = lines.where(F.length("value") >= 32)
    amt = F.trim(F.substring("value", 16, 12))
    rows = raw.select(
        F.substring("value", 1, 12).alias("unit_id"), F.substring("value", 1, 2).alias("id_state"),
        F.substring("value", 3, 1).alias("unit_type"), F.trim(F.substring("value", 13, 3)).alias("item"),
        F.when(amt == "", F.lit(0)).otherwise(amt.try_cast("long")).alias("amount_thousands"),
        F.trim(F.substring("value", 28, 4)).alias("year"), F.substring("value", 32, 1).alias("imputed"))
    return rows.where(c("amount_thousands").isNotNull())


def finance_directory(spark: SparkSession, path: str) -> DataFrame:
    """A5: the unit directory file."""
    return parse_directory_lines(positioned(spark.read.text(path)).withColumnRenamed("_at", "_file_pos"))


def parse_directory_lines(lines: DataFrame) -> DataFrame:
    """A5: directory lines (value, _file_pos); the later line wins a repeated id."""
    raw = lines.where(F.length("value") >= 116)
    rows = raw.select(F.substring("value", 1, 12).alias("unit_id"), F.trim(F.substring("value", 13, 64)).alias("name"),
                      F.trim(F.substring("value", 77, 35)).alias("county_name"),
                      F.trim(F.substring("value", 112, 5)).alias("place_code"), "_file_pos")
    return latest(rows, ["unit_id"], [c("_file_pos")], ["name", "county_name", "place_code"])


def gazetteer(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Pipe-delimited gazetteer; padding around names and values is removed."""
    raw = spark.read.csv(path, sep="|", header=True, encoding="ISO-8859-1")
    tidy = raw.select(*[F.trim(F.coalesce(raw[f"`{n}`"], F.lit(""))).alias(n.strip()) for n in raw.columns])
    opt = lambda n: c(n) if n in tidy.columns else F.lit(None).cast("string")
    return tidy.select(F.lit(kind).alias("kind"), c("GEOID").alias("geoid"), c("USPS").alias("usps"), c("NAME").alias("name"),
                       opt("FUNCSTAT").alias("funcstat"), opt("LSAD").alias("lsad"),
                       *[opt(n).try_cast("double").alias(a) for n, a in
                         (("ALAND_SQMI", "land_sqmi"), ("INTPTLAT", "lat"), ("INTPTLONG", "lon"))])


def population_keys(rows: DataFrame) -> DataFrame:
    """(sumlev, state, county, place, cousub, pop_text, rank) to (geoid, population).

    The summary level decides the key; unreadable counts are left out; the later row wins.
    """
    s = c("sumlev")
    key = (F.when(s == "040", c("state")).when(s == "050", F.concat("state", "county"))
           .when(s.isin("162", "170"), F.concat("state", "place")).when(s == "061", F.concat("state", "county", "cousub")))
    r = rows.withColumn("geoid", key).withColumn("population", F.trim("pop_text").try_cast("long"))
    r = r.where(c("geoid").isNotNull() & c("population").isNotNull())
    return latest(r, ["geoid"], [c("rank")], ["population"])


def populations(spark: SparkSession, county_path: str, sub_path: str, year: int) -> DataFrame:
    """The two population files, the sub-county one later."""
    def one(path, rank):
        raw = positioned(spark.read.csv(path, header=True, encoding="ISO-8859-1"))
        opt = lambda n: c(n) if n in raw.columns else F.lit("")
        return raw.select(c("SUMLEV").alias("sumlev"), c("STATE").alias("state"), opt("COUNTY").alias("county"), opt("PLACE").alias("place"),
                          opt("COUSUB").alias("cousub"), c(f"POPESTIMATE{year}").alias("pop_text"),
                          F.struct(F.lit(rank), "_at").alias("rank"))
    a = one(county_path, 0).where(c("sumlev").isin("040", "050"))
    b = one(sub_path, 1).where(c("sumlev").isin("162", "170", "061"))
    return population_keys(a.unionByName(b))


STATUTE_COLUMNS = ["citation", "section_title", "act_status", "text", "source_url", "last_amended_year"]


def statute_file(spark: SparkSession, path: str, state: str, snapshot: str) -> DataFrame:
    """A state's statute Parquet, only the columns the table holds; ``arrival_seq`` is the row's place in it."""
    return positioned(spark.read.parquet(path)).select(*STATUTE_COLUMNS, c("_at").alias("arrival_seq")).withColumn("state_usps", F.lit(state.upper())) \
        .withColumn("snapshot", F.lit(snapshot)) \
        .withColumn("last_amended_year", c("last_amended_year").cast("string").try_cast("long"))


def first_per_citation(sections: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """The first row per (state, snapshot, citation); rows without a citation never collide."""
    key = ["state_usps", "snapshot", "citation"]
    return first_rows(sections.where(c("citation").isNotNull()), key, [c(order)]) \
        .unionByName(sections.where(c("citation").isNull()))


def replace_slice(fresh: DataFrame, path: str) -> None:
    """Overwrite only the (state, snapshot) partitions present in ``fresh``."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state_usps", "snapshot").parquet(path)


SOURCE = T.StructType([T.StructField("url", T.StringType()), T.StructField("name", T.StringType()),
                       T.StructField("source_type", T.StringType()), T.StructField("authority_tier", T.LongType())])


def _row(text: str, longs: str, doubles: str) -> T.StructType:
    f = [T.StructField(n, T.StringType()) for n in text.split()] + [T.StructField(n, T.LongType()) for n in longs.split()]
    f += [T.StructField(n, T.DoubleType()) for n in doubles.split()] + [T.StructField("source", SOURCE)]
    f.append(T.StructField("corroborating_sources", T.ArrayType(T.StructType(
        [*SOURCE.fields, T.StructField("role", T.StringType()), T.StructField("observed_value", T.StringType())]))))
    return T.StructType(f)


DOCUMENT = {
    "findings": _row("geoid category instrument_code label status rate_unit rate_basis cap_type cap_unit cap_note "
                     "voter_approval_required effective_date expiration_date statute_cite confidence extraction_method "
                     "researcher retrieved_at notes source_quote", "fiscal_year archive_file_id", "rate_value cap_value"),
    "measures": _row("geoid election_date election_type measure_id_local official_title measure_class category instrument_code "
                     "outcome purpose_type stated_purpose threshold_basis confidence sunset_date extraction_method researcher "
                     "retrieved_at notes rate_unit",
                     "votes_yes votes_no votes_total registered_voters ballots_cast", "pct_yes threshold_required turnout_pct "
                     "margin_vs_threshold rate_value"),
    "thresholds": _row("state_usps jurisdiction_kind measure_class instrument_code purpose_restriction threshold_basis "
                       "statute_cite effective_from effective_to sunset_required reimposition_allowed petition_alternative "
                       "confidence extraction_method notes", "cooling_off_months", "threshold_value sunset_max_years"),
    "grants": _row("state_usps jurisdiction_kind category instrument_code permitted max_rate_unit stacking_rule statute_cite "
                   "effective_from effective_to confidence extraction_method notes", "", "max_rate"),
}
DOC_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("researcher", "retrieved_at", "extraction_method")]
    + [T.StructField(n, T.StringType()) for n in (*DOCUMENT, "profile")])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Research documents; ``refused`` names why a document is not usable.

    Sections stay JSON text at this step so that a section of the wrong shape is
    seen rather than silently nulled.
    """
    docs = spark.read.schema(DOC_SCHEMA).json(path, multiLine=True).withColumn("doc_path", F.col("_metadata.file_path"))
    return judge_documents(docs)


def judge_documents(docs: DataFrame) -> DataFrame:
    present = [c(s).isNotNull() for s in (*DOCUMENT, "profile")]
    none = ~present[0]
    for p in present[1:]:
        none = none & ~p
    why = F.when(none, "no_section")
    for s in DOCUMENT:
        why = why.when(c(s).isNotNull() & ~c(s).rlike(r"^\s*\["), f"{s}_not_an_array")
    return docs.withColumn("refused", why)


def section_rows(docs: DataFrame, section: str) -> DataFrame:
    """Rows of one section with their array index and the source flattened."""
    schema = T.ArrayType(DOCUMENT[section])
    arr = F.from_json(c(section), schema)
    rows = docs.where(c("refused").isNull()).select("doc_path", c("researcher").alias("_r"), c("retrieved_at").alias("_t"),
                                                     c("extraction_method").alias("_m"), F.posexplode_outer(arr).alias("pos", "row")).where(c("pos").isNotNull())
    out = rows.select("doc_path", "pos", "row.*", "_r", "_t", "_m")
    out = out.withColumn("source_url", c("source.url")).withColumn("source_type", c("source.source_type")) \
        .withColumn("authority_tier", c("source.authority_tier"))
    for name, fallback in (("extraction_method", c("_m")), ("researcher", c("_r")), ("retrieved_at", c("_t"))):
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(c(name), fallback))
    return out.drop("_r", "_t", "_m", "source")


def profile_rows(docs: DataFrame) -> DataFrame:
    """The profile section, one object or an array of them, as map<string,string>."""
    p = c("profile")
    arr = F.when(p.rlike(r"^\s*\["), F.from_json(p, "array<map<string,string>>")).otherwise(F.array(F.from_json(p, "map<string,string>")))
    return docs.where(c("refused").isNull() & p.isNotNull()).select("doc_path", F.posexplode(arr).alias("pos", "profile"))
