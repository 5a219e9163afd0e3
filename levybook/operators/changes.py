"""Rate-file facts and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import choose
from ..functions.scan import Scan, first_rows, insert_ignore, latest, running


def percent(raw: Column) -> Column:
    """Fractions become percent; values above 1 are percent already.  Four decimals."""
    return F.round(F.when(raw > 1, raw).otherwise(raw * 100.0), 4)


def rate_quote(raw: Column) -> Column:
    return F.when(raw < 1, F.format_string("%.5f", raw)).otherwise(raw.cast("string"))


def current_rates(rows: DataFrame, as_of: str) -> DataFrame:
    """Per place and instrument the newest row still in force, as a finding.

    A row is in force when open-ended or ending on or after ``as_of``; its begin
    is not tested, so a published future rate is already current.  Ties on begin
    go to the later line.  Rows that name their file (path) keep it.
    """
    inforce = rows.where(F.col("open_ended") | (F.col("end_date") >= as_of))
    pick = first_rows(inforce, ["geoid", "instrument_code"],
                      [F.coalesce("begin_date", F.lit("")).desc(), F.col("line_no").desc()])
    rate, stale = percent(F.col("rate_intra")), F.coalesce(F.col("period_year") < fixed.STALE_BEFORE_YEAR, F.lit(True))
    differs = lambda c: F.coalesce(F.abs(F.col(c) - F.col("rate_intra")) > 1e-8, F.lit(False))
    notes = F.concat_ws(" ", F.lit("General intrastate rate."),
                        F.when(differs("rate_food"), F.lit("Food rate differs.")),
                        F.when(differs("rate_inter"), F.lit("Interstate rate differs.")),
                        F.when(stale, F.lit("Source file is stale.")))
    has = F.coalesce(rate > 0, F.lit(False))
    return pick.select(
        *(["path"] if "path" in rows.columns else []), "geoid", "category", "instrument_code",
        F.when(has, "levied").otherwise("authorized_not_levied").alias("status"),
        F.when(has, rate).otherwise(F.lit(0.0)).alias("rate_value"), F.lit("percent").alias("rate_unit"),
        F.col("begin_date").alias("effective_date"),
        F.when(~F.col("open_ended"), F.col("end_date")).alias("expiration_date"),
        F.substring("begin_date", 1, 4).try_cast("long").alias("fiscal_year"),
        F.when(stale, "medium").otherwise("high").alias("confidence"),
        rate_quote(F.col("rate_intra")).alias("source_quote"), notes.alias("notes"))


def rate_events(rows: DataFrame) -> DataFrame:
    """New / increase / decrease / extended between consecutive rows of a key.

    The previous row is found by the two-level scan over quarters, so a key
    with very many periods is spread over tasks, and totals are far fewer than rows.
    """
    r = rows.withColumn("_b", F.coalesce("begin_date", F.lit(""))).withColumn("_rate", percent(F.col("rate_intra")))
    third = F.substring("_b", 7, 1)   # of a text like 1998-04-01: chunks follow the order of any text
    quarter = F.concat(F.substring("_b", 1, 6), F.when(third == "", "").when(third < "4", "0").when(third < "7", "1").otherwise("2"))
    r = running(r, ["geoid", "instrument_code"], quarter, ["_b", "line_no"],
                [Scan("_prev", "last", F.struct(F.col("_rate").alias("rate"), F.col("open_ended").alias("open")),
                      inclusive=False)])
    before, now, zero = F.col("_prev.rate"), F.col("_rate"), F.lit(0.0)
    change = (F.when(F.col("_prev").isNull(), "new")
              .when(~before.eqNullSafe(now),
                    F.when(F.coalesce(now, zero) > F.coalesce(before, zero), "increase").otherwise("decrease"))
              .when(F.col("open_ended") & ~F.col("_prev.open"), "extended"))
    return r.withColumn("change_type", change).where(F.col("change_type").isNotNull()).select(
        "geoid", "category", "instrument_code", "change_type", before.alias("rate_before"),
        now.alias("rate_after"), F.lit("percent").alias("rate_unit"), F.col("_b").alias("effective_period"),
        F.col("line_no").alias("arrival"))


def expired_events(rows: DataFrame, as_of: str) -> DataFrame:
    """The last row of a key ended before ``as_of``."""
    last = latest(rows, ["geoid", "instrument_code"],
                  [F.coalesce("begin_date", F.lit("")), F.col("line_no")],
                  ["category", "rate_intra", "end_date", "open_ended", "line_no"])
    return last.where(~F.col("open_ended") & (F.col("end_date") < as_of)).select(
        "geoid", "category", "instrument_code", F.lit("expired").alias("change_type"),
        percent(F.col("rate_intra")).alias("rate_before"), F.lit(None).cast("double").alias("rate_after"),
        F.lit("percent").alias("rate_unit"), F.col("end_date").alias("effective_period"),
        F.col("line_no").alias("arrival"))


EVENT_KEY = ["geoid", "category", "instrument_code", "change_type", "effective_period"]


def store_events(existing: DataFrame, events: DataFrame) -> DataFrame:
    """Events to append: dated, one per key, key not held yet."""
    dated = events.where(F.coalesce(F.col("effective_period"), F.lit("")) != "")
    return insert_ignore(existing, dated, EVENT_KEY, [F.col("arrival")]).drop("arrival")


def rate_geoid(jtype: Column, state_fips: Column, code: Column) -> Column:
    """county = state + 3 digits, place = state + 5, anything else has no key."""
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), r"\D", "")
    pad = lambda n: F.when(F.length(digits) >= n, digits).otherwise(F.lpad(digits, n, "0"))
    kind = choose({t: v[2] for t, v in fixed.RATE_FILE_TYPES.items()}, jtype)
    return F.when(kind == "county", F.concat(state_fips, pad(3))).when(kind == "place", F.concat(state_fips, pad(5)))


def map_rate_rows(rows: DataFrame, places: DataFrame) -> DataFrame:
    """E5: each rate row with its geoid, or the reason it has none.

    Reasons: state_authority, special_district, township_without_county,
    no_such_place, kind_mismatch; null means mapped.
    """
    t = F.col("jtype")
    r = rows.withColumn("geoid", rate_geoid(t, F.col("state_fips"), F.col("jfips"))) \
        .withColumn("_want", choose({k: v[2] for k, v in fixed.RATE_FILE_TYPES.items()}, t)) \
        .withColumn("category", choose({k: v[0] for k, v in fixed.RATE_FILE_TYPES.items()}, t)) \
        .withColumn("instrument_code", choose({k: v[1] for k, v in fixed.RATE_FILE_TYPES.items()}, t))
    # rows without a geoid meet no place; a key of their own spreads them, however many they are
    apart = F.concat(F.lit("?"), F.xxhash64("state_fips", "jtype", "jfips", *(x for x in ("path", "line_no") if x in rows.columns)).cast("string"))
    p = places.select(F.concat(F.lit("="), "geoid").alias("_place"), F.col("kind").alias("_kind"))
    r = r.withColumn("_place", F.coalesce(F.concat(F.lit("="), "geoid"), apart)).join(p, "_place", "left").drop("_place")
    fits = (F.col("_kind") == F.col("_want")) | ((F.col("_want") == "place") & (F.col("_kind") == "mcd"))
    reason = (F.when(t == fixed.STATE_AUTHORITY_TYPE, "state_authority")
              .when(F.col("_want").isNull(), "special_district")
              .when(F.col("geoid").isNull(), "township_without_county")
              .when(F.col("_kind").isNull(), "no_such_place")
              .when(~fits, "kind_mismatch"))
    return r.withColumn("reason", reason).drop("_want", "_kind")


def unmapped(mapped: DataFrame) -> DataFrame:
    """E5: the report of rows left out, keyed the way the file names them."""
    raw = F.concat_ws("/", "state_fips", "jtype", "jfips")
    keyed = F.col("reason").isin("no_such_place", "kind_mismatch")
    return mapped.where(F.col("reason").isNotNull()) \
        .select(F.when(keyed, F.col("geoid")).otherwise(raw).alias("raw_key"), "reason")
