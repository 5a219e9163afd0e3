"""Operational-log analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import choose
from ..functions.scan import anti, first_rows, flag_in, semi
from .coverage import newest_verdicts

c = F.col
ITEM = ["geoid", "category"]


def refusing_hosts(pages: DataFrame, n: int = 30) -> DataFrame:
    """K1: hosts that errored or refused, most refusals first."""
    bad = pages.where(c("error").isNotNull() | c("http_status").isin(401, 403, 429))
    host = F.regexp_extract("url", r"://([^/]*)", 1)
    return bad.groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.max("fetched_at").alias("last_seen")) \
        .orderBy(c("n").desc(), "host").limit(n)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """K2: rows per value."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def newest(df: DataFrame, where: Column, order: str, n: int, cols: list[str]) -> DataFrame:
    """K3: the newest n rows meeting a condition."""
    return df.where(where).orderBy(c(order).desc()).limit(n).select(*cols)


def newest_pages_of_runs(runs: DataFrame, pages: DataFrame, n_runs: int = 50, n_pages: int = 100) -> DataFrame:
    """K3: the newest pages of the newest runs."""
    r = runs.orderBy(c("run_id").desc()).limit(n_runs).select("run_id")
    return first_rows(semi(pages, r, ["run_id"]), ["run_id"], [c("id").desc()], n_pages)


def newest_good_pages(pages: DataFrame, n: int = 20) -> DataFrame:
    """K3: the newest error-free pages per item."""
    return first_rows(pages.where(c("error").isNull()), ITEM, [c("id").desc()], n)


FLAG_SCHEMA = "array<struct<code:string,instrument_code:string,reason:string>>"


def flag_text(flags_json: Column, n: int | None = None) -> Column:
    """The flags as text, all or the first n; malformed JSON reads as no flags."""
    arr = F.coalesce(F.from_json(flags_json, FLAG_SCHEMA), F.array().cast(FLAG_SCHEMA))
    arr = arr if n is None else F.slice(arr, 1, n)
    parts = F.transform(arr, lambda f: F.concat(F.coalesce(f["instrument_code"], F.lit("?")), F.lit(": "), F.coalesce(f["reason"], F.lit(""))))
    return F.when(F.size(arr) > 0, F.array_join(parts, "; ")).otherwise(F.lit("checker could not run"))


def activity(runs: DataFrame, uploads: DataFrame, checks: DataFrame, n: int = 30) -> DataFrame:
    """K4: newest problems over three feeds; each feed is cut to n by itself first."""
    r = runs.where(c("status").isin("failed", "stopped")).orderBy(c("run_id").desc()).limit(n).select(
        F.concat(F.lit("run_"), c("status")).alias("kind"), F.coalesce("finished_at", "started_at").alias("ts"),
        c("run_id").cast("string").alias("subject"), F.coalesce("message", F.lit("")).alias("detail"))
    u = uploads.where(c("status") == "failed").orderBy(c("id").desc()).limit(n).select(
        F.lit("intake_failed").alias("kind"), F.coalesce("finished_at", "created_at").alias("ts"),
        c("id").cast("string").alias("subject"), F.coalesce("error", F.lit("")).alias("detail"))
    k = checks.where(c("verdict").isin("flag", "error")).orderBy(c("id").desc()).limit(n).select(
        F.concat(F.lit("check_"), c("verdict")).alias("kind"), c("created_at").alias("ts"),
        F.concat_ws("/", "geoid", "category").alias("subject"), flag_text(c("flags")).alias("detail"))
    return r.unionByName(u).unionByName(k).orderBy(c("ts").desc(), "kind", "subject").limit(n)


def timeline(checks: DataFrame, runs: DataFrame, batches: DataFrame, as_of_ts: str, n: int = 8) -> DataFrame:
    """K5: what happened in the last 48 hours, the n newest; each feed is cut to n by itself first."""
    edge = F.lit(as_of_ts).cast("timestamp_ntz") - F.expr("interval 48 hours")
    ch = checks.where(c("created_at") >= edge).groupBy(
        F.when(c("verdict") == "pass", "checks_passed").otherwise("checks_flagged").alias("kind")) \
        .agg(F.max("created_at").alias("ts"), F.count("*").alias("n"))
    r = runs.where(c("started_at") >= edge).orderBy(F.coalesce("finished_at", "started_at").desc(), c("run_id").desc()).limit(n).select(
        F.concat(F.lit("run_"), c("status")).alias("kind"), F.coalesce("finished_at", "started_at").alias("ts"),
        c("pages_fetched").alias("n"))
    b = batches.where(F.coalesce("collected_at", "submitted_at", "created_at") >= edge)
    ev = F.array_compact(F.array(
        F.when(c("submitted_at").isNotNull(), F.struct(F.lit("batch_sent").alias("kind"), c("submitted_at").alias("ts"))),
        F.when(c("collected_at").isNotNull(), F.struct(F.lit("batch_back").alias("kind"), c("collected_at").alias("ts"))),
        F.when(c("status") == "failed", F.struct(F.lit("batch_failed").alias("kind"),
                                                 F.coalesce("collected_at", "submitted_at", "created_at").alias("ts")))))
    b = b.select(F.explode(ev).alias("e"), c("n_items").alias("n")).select("e.kind", "e.ts", "n")
    return ch.unionByName(r).unionByName(b).orderBy(c("ts").desc_nulls_last(), "kind").limit(n)


def run_counters(runs: DataFrame, pages: DataFrame, written: DataFrame) -> DataFrame:
    """K6: pages and findings per run, from their logs."""
    p = pages.groupBy("run_id").agg(F.count("*").alias("pages_fetched"))
    f = written.groupBy("run_id").agg(F.count("*").alias("findings_written"), F.count_distinct("geoid").alias("items_claimed"))
    return runs.select("run_id").join(p, "run_id", "left").join(f, "run_id", "left") \
        .fillna(0, ["pages_fetched", "findings_written", "items_claimed"])


def search_log(existing: DataFrame, rounds: DataFrame) -> DataFrame:
    """K7: fold search rounds into the log: tries, last outcome, and the last results that were not empty.

    Outcomes: a blocked engine says nothing about the wording, so it is kept apart from 'nothing'.
    """
    key = [*ITEM, "query"]
    r = rounds.groupBy(*key).agg(F.count("*").alias("tries"), F.max_by("outcome", "round_seq").alias("last_outcome"),
                                 F.max("tried_at").alias("last_tried_at"),
                                 F.max_by("results", F.when(c("results").isNotNull(), c("round_seq"))).alias("results"))
    e = existing.select(*key, *[c(x).alias(f"_{x}") for x in ("source", "tries", "last_outcome", "last_tried_at", "results")])
    j = e.join(r, key, "full")
    return j.select(*key, F.coalesce("_source", F.lit("built_in")).alias("source"),
                    (F.coalesce("_tries", F.lit(0)) + F.coalesce("tries", F.lit(0))).cast("long").alias("tries"),
                    *[F.coalesce(x, f"_{x}").alias(x) for x in ("last_outcome", "last_tried_at", "results")])


def _fresh(log, as_of_ts, days):
    edge = F.lit(as_of_ts).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
    urls = F.filter(F.coalesce(F.from_json("results", "array<string>"), F.array().cast("array<string>")), lambda u: u.isNotNull())
    return log.where(c("last_tried_at") >= edge).withColumn("urls", urls).where(F.size("urls") > 0)


def reusable_results(plan: DataFrame, log: DataFrame, as_of_ts: str, days: int = 7) -> DataFrame:
    """K8: URLs on file for planned queries, in plan order, each once per item."""
    key = [*ITEM, "query"]
    f = plan.join(_fresh(log, as_of_ts, days).select(*key, "urls"), key) \
        .select(*ITEM, "pos", F.posexplode("urls").alias("url_pos", "url"))
    return f.groupBy(*ITEM, "url").agg(F.min(F.struct("pos", "url_pos")).alias("_at")) \
        .select(*ITEM, "url", c("_at.pos").alias("pos"), c("_at.url_pos").alias("url_pos"))


def queries_to_ask(plan: DataFrame, log: DataFrame, as_of_ts: str, days: int = 7) -> DataFrame:
    """K8: planned queries without reusable results."""
    return anti(plan, _fresh(log, as_of_ts, days), [*ITEM, "query"])


def plan_round(built_in: DataFrame, log: DataFrame, exclude: DataFrame | None = None, n: int = fixed.MAX_QUERIES_PER_ROUND) -> DataFrame:
    """K9: the next queries per item: untried suggestions, live templates, then suggestions that worked.

    A wording that found nothing is dead; when everything of an item is dead and nothing
    was excluded for that item, its templates are asked again.  The first n of each item.
    """
    key = [*ITEM, "query"]
    dead = log.where(c("last_outcome") == "nothing")
    ai = log.where(c("source") == "ai")
    first = ai.where(c("tries") == 0).select(*key, F.lit(0).alias("tier"), c("log_id").alias("pos"))
    retry = ai.where((c("tries") > 0) & c("last_outcome").isin("found", "blocked")).select(*key, F.lit(2).alias("tier"), c("log_id").alias("pos"))
    tmpl = anti(built_in, dead, key).select(*key, F.lit(1).alias("tier"), c("pos").cast("long").alias("pos"))
    allq = first.unionByName(tmpl).unionByName(retry)
    last_resort = built_in.join(allq.select(*ITEM).distinct(), ITEM, "left_anti") \
        .select(*key, F.lit(3).alias("tier"), c("pos").cast("long").alias("pos"))
    if exclude is not None:
        allq = anti(allq, exclude, key)
        last_resort = anti(last_resort, exclude.select(*ITEM).distinct(), ITEM)
    allq = allq.unionByName(last_resort)
    once = allq.groupBy(*key).agg(F.min(F.struct("tier", "pos")).alias("_at"))
    return first_rows(once, ITEM, [c("_at.tier"), c("_at.pos"), c("query")], n, "rank") \
        .select(*key, c("_at.tier").alias("tier"), c("rank").cast("long").alias("rank"))


def needs_new_wording(items: DataFrame, facts: DataFrame, measures: DataFrame, thresholds: DataFrame, grants: DataFrame,
                      places: DataFrame, checks: DataFrame) -> DataFrame:
    """Items with nothing live on file, or whose newest verdict was flag or error."""
    j = items.join(places.select("geoid", "state_usps"), "geoid", "left").withColumn("state_usps", F.coalesce("state_usps", "geoid"))
    j = flag_in(j, facts.where(c("superseded_by").isNull()), ITEM, "_fact")
    j = flag_in(j, measures.where(c("superseded_by").isNull()), ["geoid"], "_measure")
    j = flag_in(j, thresholds.select("state_usps").unionByName(grants.select("state_usps")), ["state_usps"], "_rule")
    held = (F.when(c("category") == fixed.COUNTY_PASS, c("_measure")).when(c("category") == fixed.STATE_PASS, c("_rule"))
            .otherwise(c("_fact")))
    j = j.join(newest_verdicts(checks), ITEM, "left")
    bad = F.coalesce(c("verdict").isin("flag", "error"), F.lit(False))
    return j.where(~held | bad).select(*ITEM, (~held).cast("int").alias("nothing_on_file"), bad.cast("int").alias("last_check_failed"))


def search_wording(items: DataFrame) -> DataFrame:
    """The standard queries of an item (name, state, kind, category), in order."""
    def fill(t: str) -> Column:
        out = F.lit(t)
        for k, v in (("{name}", c("name")), ("{state}", c("state")), ("{kind}", word), ("{cat}", cat)):
            out = F.replace(out, F.lit(k), v) if k in t else out
        return out
    cat = F.replace(F.coalesce("category", F.lit("tax")), F.lit("_"), F.lit(" "))
    word = F.coalesce(choose(fixed.KIND_WORD, c("kind")), F.lit("government"))
    sets = {k: F.array(*[fill(t) for t in v]) for k, v in fixed.QUERY_TEMPLATES.items()}
    q = F.when(c("category") == "framework", sets["framework"]).when(c("category") == "elections", sets["elections"]).otherwise(sets["*"])
    return items.select(*ITEM, F.posexplode(q).alias("pos", "query"))


def monthly_calls(calls: DataFrame, cap: int) -> DataFrame:
    """Paid searches per month and whether the ceiling was reached (0 = none)."""
    g = calls.groupBy(F.date_format("tried_at", "yyyy-MM").alias("month")).agg(F.sum("api_calls").alias("calls"))
    return g.withColumn("cap_reached", (F.lit(cap > 0) & (c("calls") >= cap)).cast("int"))


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Dollars per response; unlisted models cost the high rate, batch reads half.

    ``prices`` is a table (model, usd_in, usd_out) per million tokens.
    """
    j = usage.join(prices, F.trim(usage["model"]) == prices["model"], "left").drop(prices["model"])
    pin = F.coalesce("usd_in", F.lit(fixed.FALLBACK_PRICE[0]))
    pout = F.coalesce("usd_out", F.lit(fixed.FALLBACK_PRICE[1]))
    n = lambda x: F.coalesce(c(x), F.lit(0))
    usd = (n("input_tokens") * pin + n("cache_write_tokens") * pin * fixed.CACHE_WRITE_FACTOR
           + n("cache_read_tokens") * pin * fixed.CACHE_READ_FACTOR + n("output_tokens") * pout) / 1e6
    return j.withColumn("usd", F.when(c("is_batch") == 1, usd / 2.0).otherwise(usd)).drop("usd_in", "usd_out")


def spend_checkpoints(priced: DataFrame, step: float, unit: str = "day") -> DataFrame:
    """Spend per period, running total, and where the checkpoint stopped work.

    The stop rule looks back to the last stop, not to multiples of the step, so
    it is a fold.  Spend is summed per period first; the fold then runs over the
    calendar only, whatever the number of responses.  A step of zero or less turns the
    checkpoint off.
    """
    per = priced.groupBy(F.date_trunc(unit, c("ts")).cast("timestamp_ntz").alias("period")).agg(F.sum("usd").alias("usd"))
    days = per.agg(F.array_sort(F.collect_list(F.struct("period", "usd"))).alias("days"))
    start = F.expr("named_struct('total', 0D, 'acked', 0D, 'out', cast(array() as "
                   "array<struct<period:timestamp_ntz,usd:double,total:double,stopped:boolean>>))")

    def step_fn(acc, d):
        total = acc["total"] + F.coalesce(d["usd"], F.lit(0.0))
        stop = (F.round(total - acc["acked"], 6) >= step) & F.lit(step > 0)
        row = F.struct(d["period"].alias("period"), d["usd"].alias("usd"), total.alias("total"), stop.alias("stopped"))
        return F.struct(total.alias("total"), F.when(stop, total).otherwise(acc["acked"]).alias("acked"),
                        F.concat(acc["out"], F.array(row)).alias("out"))

    out = days.select(F.explode(F.aggregate("days", start, step_fn)["out"]).alias("r"))
    return out.select(c("r.period").alias("period"), F.round("r.usd", 4).alias("usd"), F.round("r.total", 4).alias("total"),
                      c("r.stopped").cast("int").alias("stopped"))
