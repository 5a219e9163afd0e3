"""Integrity checks.

Each check yields keys of offending rows.  Checks that look at one row (and its
source) are predicates, so ``run`` tests all of them in one pass over the facts,
one over the measures and one per rule table; the others are joins.  ``summary``
counts per check and keeps eight example keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import blank, lenient_date, squash
from ..functions.scan import anti, first_rows

c = F.col
#: Checks that need joins between tables: code -> function of the tables.
JOINED: dict[str, Callable] = {}


def _check(code: str):
    def deco(fn):
        JOINED[code] = fn
        return fn
    return deco


def _key(*cols: str) -> Column:
    """Readable key: parts joined by '|', nulls as '-'."""
    return F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("-")) for x in cols])


def _live(t): return t.facts.where(c("superseded_by").isNull())
def _src(t): return t.source.select(c("id").alias("source_id"), c("url").alias("_url"), c("authority_tier").alias("_tier"))


def fact_rules(as_of: str) -> dict[str, Column]:
    """On a live fact with its source's ``_url`` and ``_tier``."""
    rate, unit, exp = c("rate_value"), c("rate_unit"), c("expiration_date")
    edge = F.date_format(F.date_sub(F.lit(as_of).cast("date"), 400), "yyyy-MM-dd")
    return {
        "g01": F.coalesce("_url", F.lit("")) == "",
        "g02": (c("status") == "levied") & rate.isNull(),
        "g03": rate.isNotNull() & unit.isNull(),
        "g04": (unit == "percent") & ((rate < 0) | (rate > 25)),
        "g05": unit.eqNullSafe(c("cap_unit")) & (rate > c("cap_value")),
        "g06": c("_tier") == 4,
        "g10": c("retrieved_at") < edge,
        "g11": exp.isNotNull() & lenient_date(exp).isNull(),
        "g25": (c("extraction_method") == "agent_research") & blank(c("source_quote")),
    }


def measure_rules() -> dict[str, Column]:
    """G12, G13, G19-G21."""
    now, pct, need = c("superseded_by").isNull(), c("pct_yes"), c("threshold_required")
    share = F.when(c("votes_total") > 0, 100.0 * c("votes_yes") / c("votes_total"))
    return {
        "g12": (c("outcome") == "passed") & (c("margin_vs_threshold") < 0),
        "g13": F.abs(pct - share) > 0.15,
        "g19": now & pct.isNotNull() & need.isNull(),
        "g20": F.abs(c("margin_vs_threshold") - (pct - need)) > 0.05,
        "g21": now & c("votes_total").isNull() & pct.isNull(),
    }


def threshold_rules() -> dict[str, Column]:
    """G16, G17."""
    return {"g16": c("threshold_value") <= 1.0, "g17": blank(c("statute_cite"))}


def grant_rules() -> dict[str, Column]:
    """G17, G18."""
    return {"g17": blank(c("statute_cite")), "g18": c("max_rate").isNotNull() & (F.coalesce("max_rate_unit", F.lit("")) == "")}


def _one_pass(df: Callable[[], DataFrame], rules: dict[str, Column], key: Callable[[str], Column], only) -> DataFrame | None:
    """(check_id, key) of every rule that fires, by one scan."""
    picked = {k: p for k, p in rules.items() if not only or k in only}
    if not picked:
        return None
    df = df()
    hits = F.array_compact(F.array(*[F.when(p, F.struct(F.lit(k).alias("check_id"), key(k).alias("key"))) for k, p in picked.items()]))
    return df.select(F.explode(hits).alias("h")).select("h.check_id", "h.key")


def _complete(t): return t.work.where(c("status") == "complete")


@_check("g07")
def complete_without_findings(t):
    w = _complete(t).where(~c("category").isin("framework", "elections"))
    return anti(w, _live(t), ["geoid", "category"]).select(_key("geoid", "category").alias("key"))


@_check("g08")
def framework_without_rules(t):
    w = _complete(t).where(c("category") == "framework").join(t.jurisdiction.select("geoid", "state_usps"), "geoid")
    for rules in (t.thresholds, t.grants, t.state_profile):
        w = anti(w, rules, ["state_usps"])
    return w.select(_key("geoid", "category").alias("key"))


@_check("g09")
def elections_without_measures(t):
    w = _complete(t).where(c("category") == "elections")
    w = anti(anti(w, t.measures, ["geoid"]), _covered(t), ["geoid"])
    return w.select(_key("geoid", "category").alias("key"))


def _covered(t):
    return t.coverage_assertion.where(c("domain") == "ballot_measure").select(c("scope_geoid").alias("geoid"))


@_check("g14")
def event_orphan(t):
    e = t.rate_change.where(c("measure_id").isNotNull())
    return e.join(t.measures.select(c("id").alias("measure_id")), "measure_id", "left_anti") \
        .select(_key("geoid", "instrument_code", "change_type", "effective_period").alias("key"))


@_check("g15")
def weak_and_alone(t):
    backed = t.claim_source.where((c("claim_table") == "tax_instrument") & (c("role") == "corroborating") & (c("agrees") == 1)) \
        .select(c("claim_id").alias("id")).distinct()
    weak = _live(t).join(_src(t).where(c("_tier") == 4), "source_id")
    return anti(weak, backed, ["id"]).select(_key("id").alias("key"))


def _live_m(t): return t.measures.where(c("superseded_by").isNull())


def _states_of(t, rows): return rows.select("geoid").distinct().join(t.jurisdiction.select("geoid", "state_usps"), "geoid").select("state_usps").distinct()


@_check("g22")
def rates_no_caps(t): return anti(_states_of(t, _live(t)), t.grants, ["state_usps"]).select(c("state_usps").alias("key"))


@_check("g23")
def measures_no_thresholds(t):
    return anti(_states_of(t, _live_m(t)), t.thresholds, ["state_usps"]).select(c("state_usps").alias("key"))


@_check("g24")
def measured_uncovered(t):
    return anti(t.measures.select("geoid").distinct(), _covered(t), ["geoid"]).select(c("geoid").alias("key"))


@_check("g26")
def quote_not_archived(t):
    """Quotes absent from the archived text, spaces aside; text is normalised once per file."""
    q = _live(t).where(~blank(c("source_quote"))).select("id", "archive_file_id", F.trim(squash(c("source_quote"))).alias("_quote")).where(c("_quote") != "")
    # each quote is searched once per file, whatever the number of facts that cite it
    asked = q.select("archive_file_id", "_quote").distinct()
    # texts are dealt by the key of the join before they are normalised: a table may lie in one split
    text = t.archive_text.repartition("archive_file_id").select("archive_file_id", squash(c("text")).alias("_text"))
    absent = asked.join(text, "archive_file_id").where(~c("_text").contains(c("_quote"))).select("archive_file_id", "_quote")
    return q.join(absent, ["archive_file_id", "_quote"], "left_semi").select(_key("id").alias("key"))


def run(t, only: list[str] | None = None) -> DataFrame:
    """All checks (or some) as one frame of (check_id, key)."""
    def facts():
        if not only or {"g01", "g06"} & set(only):
            return _live(t).join(_src(t), "source_id", "left")
        return _live(t).withColumn("_url", F.lit("-")).withColumn("_tier", F.lit(0))

    by_id = lambda label: (lambda k: F.concat(F.lit(label if k == "g17" else ""), c("id").cast("string")))
    parts = [
        _one_pass(facts, fact_rules(t.as_of), lambda k: c("id") if k == "g25" else _key("geoid", "instrument_code", "id"), only),
        _one_pass(lambda: t.measures, measure_rules(), by_id(""), only),
        _one_pass(lambda: t.thresholds, threshold_rules(), by_id("threshold|"), only),
        _one_pass(lambda: t.grants, grant_rules(), by_id("grant|"), only),
    ]
    parts += [fn(t).select(F.lit(code).alias("check_id"), "key") for code, fn in JOINED.items() if not only or code in only]
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return out


def summary(rows: DataFrame, sample: int = 8) -> DataFrame:
    """Count and the first keys per check; every check that ran is listed."""
    n = rows.groupBy("check_id").agg(F.count("*").alias("n"))
    few = first_rows(rows, ["check_id"], [c("key")], sample) \
        .groupBy("check_id").agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("examples"))
    return n.join(few, "check_id")


def verdict(rows: DataFrame) -> DataFrame:
    """Total flagged rows, and whether a strict run fails."""
    return rows.agg(F.count("*").alias("flagged")).withColumn("strict_failure", (c("flagged") > 0).cast("int"))
