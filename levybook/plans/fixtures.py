"""Ledger tables shaped from the driver's synthetic tables.

``SQL`` holds each view in the dialect both engines share (see FIXTURES.md): the
oracle prefixes these as CTEs and Spark runs the same text, except where a
``row_number`` would put a hot key into one task (built with the two-level scan)
or a cross join stands for a fixed list (exploded).
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import Scan, running
from ..functions.shared import kept

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

AS_OF = "1998-06-30"
AS_OF_TS = "2024-01-31 00:00:00"


def _load_sql() -> dict[str, str]:
    text = (Path(__file__).resolve().parent / "fixtures.sql").read_text()
    out = {}
    for block in re.split(r"^-- view: ", text, flags=re.M)[1:]:
        name, body = block.split("\n", 1)
        out[name.strip()] = body.strip()
    return out


SQL = _load_sql()
_WORD = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)", re.I)
NEEDS = {v: [t for t in dict.fromkeys(_WORD.findall(sql)) if t in SQL or t in BASE]
         for v, sql in SQL.items()}


class Tables:
    """Lazy access to base tables and fixture views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._memo = spark, sf_dir, {}
        self.as_of, self.as_of_ts = AS_OF, AS_OF_TS

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._memo:
            self._memo[name] = self._build(name)
        return self._memo[name]

    def keep(self, name: str, df: DataFrame) -> None:
        """Use this frame for a view from now on."""
        self._memo[name] = df

    def store(self, *names: str) -> Tables:
        """Views that feed many steps, evaluated once and read back, as stored tables would be."""
        for name in names:
            self.keep(name, kept(getattr(self, name), name))
        return self

    def _build(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name == "numbered":
            return _numbered(self)
        if name == "rate_history":
            return rate_history(self)
        if name == "tax_instrument":
            return tax_instrument(self)
        if name == "rate_arrival":
            return rate_arrival(self)
        if name == "work_item":
            return work_item(self)
        if name in DERIVED:
            return DERIVED[name](self)
        deps = {d: getattr(self, d) for d in NEEDS[name]}
        sql = _WORD.sub(lambda m: m.group(0).replace(m.group(1), "{" + m.group(1) + "}")
                        if m.group(1) in deps else m.group(0), SQL[name])
        return self.spark.sql(sql, **deps)


def rate_history(t: Tables) -> DataFrame:
    """Every rate version, numbered per place and instrument in date order."""
    return t.numbered.drop("top_seq")


def _numbered(t: Tables) -> DataFrame:
    """The history with each key's number of versions."""
    line = t.lineitem.select("l_suppkey", "l_linenumber", "l_shipdate", "l_orderkey", "l_partkey",
                             "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                             "l_returnflag", "l_linestatus")
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    num = running(line, ["l_suppkey", "l_linenumber"], F.trunc(F.col("l_shipdate").cast("date"), "quarter"),
                  order, [Scan("seq", "sum", F.lit(1).cast("long")), Scan("top_seq", "sum", F.lit(1).cast("long"), whole=True)])
    n = F.col("l_linenumber")
    sup = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return num.join(sup, "l_suppkey").select(
        F.concat(F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0"),
                 F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("geoid"),
        F.when(n.isin(1, 2, 3), "sales_use").when(n == 4, "lodging_meals")
        .when(n.isin(5, 6), "property").otherwise("other_levy").alias("category"),
        F.when(n == 1, "county_general_sales").when(n == 2, "use_tax").when(n == 3, "special_purpose_sales")
        .when(n == 4, "transient_lodging").when(n == 5, "general_operating_levy")
        .when(n == 6, "debt_service_levy").otherwise("franchise_fee").alias("instrument_code"),
        F.col("seq").cast("long").alias("seq"),
        F.when(F.col("l_returnflag") == "R", "repealed").when(F.col("l_returnflag") == "A", "authorized_not_levied")
        .otherwise("levied").alias("status"),
        F.round(F.col("l_tax") * 100).cast("long").alias("rate_pct"),
        F.col("l_shipdate").cast("date").cast("string").alias("effective_date"), F.col("top_seq").cast("long").alias("top_seq"))


def tax_instrument(t: Tables) -> DataFrame:
    """Facts with deliberate defects; the newest version of a key is the live row."""
    keys = ["geoid", "category", "instrument_code"]
    s = F.col("seq")
    return t.numbered.select(
        *keys, "seq", "status",
        F.when(~((F.col("status") == "levied") & (s % 17 == 0)), F.col("rate_pct").cast("double")).alias("rate_value"),
        F.when(s % 9 == 0, "mills").when(s % 9 != 1, "percent").alias("rate_unit"),
        F.when(s % 4 == 0, F.lit(5.0)).alias("cap_value"),
        F.when(s % 8 == 0, "mills").otherwise("percent").alias("cap_unit"),
        "effective_date",
        F.when(s % 6 == 0, "6/30/1999").when(s % 6 == 1, F.lit(None)).when(s % 6 == 2, "1999-02-31")
        .when(s % 6 == 3, "2000-12-31").when(s % 6 == 4, "1998-08-01").otherwise("2010-01-01").alias("expiration_date"),
        F.when(s % 3 == 0, "bulk_import").when(s % 3 == 1, "agent_research").otherwise("manual").alias("extraction_method"),
        F.when(s % 5 == 0, "low").when(s % 5 == 1, "medium").otherwise("high").alias("confidence"),
        F.when(s % 10 == 0, "").when(s % 10 != 1, F.concat(F.lit("the rate is "), F.col("rate_pct").cast("string"),
                                                            F.lit(" percent"))).alias("source_quote"),
        F.col("effective_date").alias("retrieved_at"),
        F.when(s != F.col("top_seq"), s + 1).alias("superseded_by_seq"),
        F.substring("geoid", 3, 10).cast("long").alias("source_id"))


def work_item(t: Tables) -> DataFrame:
    """Items per place and category; the categories are exploded, not cross joined."""
    cats = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("category")) for i, k in
                     enumerate(["property", "sales_use", "lodging_meals", "elections", "framework"], start=1)])
    pop = F.coalesce("population", F.lit(0))
    rows = t.jurisdiction.select("geoid", "kind", "name", "population", F.explode(cats).alias("k")) \
        .select("geoid", "kind", "name", "population", "k.i", "k.category")
    fits = F.when(F.col("category") == "framework", F.col("kind") == "state") \
        .when(F.col("category") == "elections", F.col("kind") == "county").otherwise(F.col("kind").isin("county", "place"))
    turn = (F.length("name") + pop + F.col("i")) % 7
    names = ["pending", "in_progress", "needs_review", "complete", "no_data", "blocked", "awaiting_ai"]
    status = F.element_at(F.array(*[F.lit(x) for x in names]), turn.cast("int") + 1)
    return rows.where(fits).select("geoid", "category", status.alias("status"), ((pop + F.col("i")) % 6).cast("bigint").alias("attempts"))


def rate_arrival(t: Tables) -> DataFrame:
    """The history in a shuffled order of arrival; totals and rows of the scan read it, so it is stored."""
    h = t.store("numbered").rate_history.withColumn("_mix", (F.col("seq") * 7919) % 10007)
    return running(h, ["geoid", "instrument_code"], F.floor(F.col("_mix") / 1000), ["_mix", "seq"],
                   [Scan("arrival_seq", "sum", F.lit(1).cast("long"))]).drop("_mix")


#: Views the operators themselves produce (filled by ``derived``); name -> builder.
DERIVED: dict = {}


def derived(name: str, sql: str):
    """Register a view built by operators, with its oracle text."""
    def deco(fn):
        DERIVED[name] = fn
        SQL[name] = sql.strip()
        return fn
    return deco


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Oracle text: the query with every fixture view it names put in front as CTEs."""
    ctes = {**SQL, **(extra or {})}
    order: list[str] = []

    def add(name):
        if name in order or name not in ctes:
            return
        for dep in dict.fromkeys(_WORD.findall(ctes[name])):
            if dep != name:
                add(dep)
        order.append(name)

    for name in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", sql)):
        if name in ctes and re.search(r"\b(?:FROM|JOIN)\s+%s\b" % name, sql, re.I):
            add(name)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS (\n{ctes[n]}\n)" for n in order)
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\s", body, re.I):
        return f"WITH RECURSIVE {head},\n" + re.sub(r"^WITH\s+RECURSIVE\s", "", body, flags=re.I)
    if re.match(r"WITH\s", body, re.I):
        return f"WITH {head},\n" + re.sub(r"^WITH\s", "", body, flags=re.I)
    return f"WITH {head}\n{body}"

