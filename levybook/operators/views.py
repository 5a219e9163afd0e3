"""Product views (F1-F9): functions from ledger tables to result tables.

``as_of`` is an ISO date string; effective bounds are ISO text and compare as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import lenient_date
from ..functions.scan import first_rows


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("superseded_by").isNull())


def in_force(as_of: str) -> Column:
    return ((F.col("effective_from").isNull() | (F.col("effective_from") <= as_of))
            & (F.col("effective_to").isNull() | (F.col("effective_to") >= as_of)))


def current_tax(facts: DataFrame, places: DataFrame, sources: DataFrame) -> DataFrame:
    """live facts with their place and citation."""
    p = places.select("geoid", F.col("name").alias("jurisdiction_name"), "kind", "state_usps", "population")
    s = sources.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"),
                       F.col("name").alias("source_name"), "authority_tier")
    return live(facts).join(p, "geoid").join(s, "source_id")


def sunset_watch(facts: DataFrame, places: DataFrame, measures: DataFrame, as_of: str) -> DataFrame:
    """levies expiring from 180 days ago to 1095 days ahead, with the place's record at the polls.

    The count skips superseded measures; the best share does not.
    """
    revenue = measures.where(F.col("measure_class").isin(fixed.REVENUE_CLASSES))
    record = revenue.groupBy("geoid").agg(
        F.count_if(F.col("superseded_by").isNull()).alias("prior_revenue_measures"),
        F.max(F.when(F.col("outcome") == "passed", F.col("pct_yes"))).alias("best_prior_yes"))
    days = F.datediff(lenient_date(F.col("expiration_date")), F.lit(as_of).cast("date"))
    levied = live(facts).where(F.col("status") == "levied").withColumn("days_out", days.cast("long")) \
        .where(F.col("days_out").between(-180, 1095))
    return levied.join(places.select("geoid", "name", "kind", "state_usps", "population"), "geoid") \
        .join(record, "geoid", "left") \
        .select("state_usps", "name", "kind", "population", "geoid", "category", "instrument_code",
                "rate_value", "rate_unit", "expiration_date", "days_out",
                F.coalesce("prior_revenue_measures", F.lit(0)).alias("prior_revenue_measures"), "best_prior_yes")


def _newest_in_force(rules: DataFrame, group: list[str], as_of: str) -> DataFrame:
    return first_rows(rules.where(in_force(as_of)), group,
                      [F.coalesce("effective_from", F.lit("0000")).desc(), F.col("id").desc()])


def live_grants(grants: DataFrame, as_of: str) -> DataFrame:
    """one grant per (state, instrument, kind); the winner may be a revocation, which yields none."""
    won = _newest_in_force(grants, ["state_usps", "instrument_code", "jurisdiction_kind"], as_of)
    return won.where(F.col("permitted") == "yes")


def live_thresholds(rules: DataFrame, as_of: str) -> DataFrame:
    """one threshold per (state, class, kind, instrument, purpose)."""
    return _newest_in_force(rules, ["state_usps", "measure_class", "jurisdiction_kind",
                                    "instrument_code", "purpose_restriction"], as_of)


def headroom(places: DataFrame, grants: DataFrame, facts: DataFrame, as_of: str) -> DataFrame:
    """cap minus what is levied in the cap's own unit.

    A kind's own grant wins; the statewide one serves kinds without one.  Live
    grants are reduced to one row per (state, kind, instrument) first, and the
    fallback is settled among grants, before any place is joined.
    """
    g = live_grants(grants, as_of)
    own = g.where(F.col("jurisdiction_kind").isNotNull()).withColumn("kind", F.col("jurisdiction_kind"))
    wide = g.where(F.col("jurisdiction_kind").isNull()) \
        .withColumn("kind", F.explode(F.array(*[F.lit(k) for k in fixed.KINDS])))
    wide = wide.join(own.select("state_usps", "instrument_code", "kind"),
                     ["state_usps", "instrument_code", "kind"], "left_anti")
    rules = own.unionByName(wide).withColumnRenamed("id", "grant_id") \
        .select("state_usps", "kind", "grant_id", "category", "instrument_code", "max_rate",
                "max_rate_unit", "stacking_rule", "statute_cite")
    levied = live(facts).where((F.col("status") == "levied") & F.col("rate_value").isNotNull()) \
        .groupBy("geoid", "instrument_code", F.col("rate_unit").alias("max_rate_unit")) \
        .agg(F.sum("rate_value").alias("levied"))
    out = places.select("geoid", "name", "state_usps", "kind", "population") \
        .join(rules, ["state_usps", "kind"]) \
        .join(levied, ["geoid", "instrument_code", "max_rate_unit"], "left")
    rate = F.coalesce(F.col("levied"), F.lit(0.0))
    return out.select("geoid", "name", "state_usps", "kind", "population", "grant_id", "category",
                      "instrument_code", "max_rate", "max_rate_unit", rate.alias("levied_rate"),
                      (F.col("max_rate") - rate).alias("headroom"), "stacking_rule", "statute_cite")


def near_miss(measures: DataFrame, places: DataFrame, as_of: str) -> DataFrame:
    """revenue measures of the last six years that failed by at most eight points."""
    since = F.date_format(F.add_months(F.lit(as_of).cast("date"), -72), "yyyy-MM-dd")
    m = live(measures).where(
        (F.col("outcome") == "failed") & F.col("measure_class").isin(fixed.REVENUE_CLASSES)
        & F.col("margin_vs_threshold").between(-8.0, 0.0) & (F.col("election_date") >= since))
    return m.join(places.select("geoid", "state_usps", "name", "population"), "geoid").select(
        "state_usps", "name", "population", "election_date", "measure_id_local", "measure_class",
        "pct_yes", "threshold_required", "margin_vs_threshold")


def capture_gap(events: DataFrame, places: DataFrame, grants: DataFrame, as_of: str) -> DataFrame:
    """rises that no recorded measure explains, where the state grants the instrument."""
    granted = live_grants(grants, as_of).select("state_usps", "instrument_code").distinct()
    e = events.where(F.col("measure_id").isNull() & F.col("change_type").isin("new", "increase", "extended"))
    return e.join(places.select("geoid", "state_usps", "name", "population"), "geoid") \
        .join(granted, ["state_usps", "instrument_code"], "left_semi") \
        .select("state_usps", "name", "geoid", "population", "category", "instrument_code", "change_type",
                "rate_before", "rate_after", "effective_period")


def coverage(work: DataFrame, places: DataFrame) -> DataFrame:
    """F8: items and population by state, kind, category and status."""
    return work.join(places.select("geoid", "state_usps", "kind", "population"), "geoid") \
        .groupBy("state_usps", "kind", "category", "status") \
        .agg(F.count("*").alias("n"), F.sum(F.coalesce("population", F.lit(0))).alias("pop"))


def headroom_top(head: DataFrame, n: int = 25) -> DataFrame:
    """unused authority in the most populous places."""
    return head.where(F.col("headroom") > 0) \
        .orderBy(F.col("population").desc_nulls_last(), "geoid", "instrument_code").limit(n)


def sunset_top(watch: DataFrame, n: int = 25) -> DataFrame:
    """the soonest expirations."""
    return watch.orderBy("days_out", "geoid", "instrument_code").limit(n)


def near_miss_top(misses: DataFrame, n: int = 25) -> DataFrame:
    """the closest defeats."""
    return misses.orderBy(F.col("margin_vs_threshold").desc(), "measure_id_local").limit(n)


def capture_gap_top(gap: DataFrame, n: int = 25) -> DataFrame:
    """the newest unexplained rises of the first states."""
    return gap.orderBy("state_usps", F.col("effective_period").desc(), "geoid", "instrument_code",
                       "change_type").limit(n)
