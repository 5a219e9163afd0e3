"""Work-ledger transitions (I1-I17): each takes tables and returns tables.

Times come from an explicit ``as_of_ts``; nothing reads the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import choose
from ..functions.scan import anti, flag_in, semi
from .merge import bulk_answered

c = F.col
ITEM = ["geoid", "category"]


def priority(kind: Column, population: Column) -> Column:
    """Kind weight times squared log population."""
    w = F.coalesce(choose(fixed.KIND_WEIGHT, kind), F.lit(1))
    return F.floor(w * F.pow(F.log10(F.coalesce(population, F.lit(0)) + 10), F.lit(2.0))).cast("long")


def most_populous(places: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return places
    return places.orderBy(F.coalesce("population", F.lit(0)).desc(), "geoid").limit(n)


def select_places(places: DataFrame, states=None, kinds=("county", "place"), min_pop=0, geoids: DataFrame | None = None) -> DataFrame:
    p = places.where(c("kind").isin(*kinds))
    if states:
        p = p.where(c("state_usps").isin([s.upper() for s in states]))
    if min_pop:
        p = p.where(F.coalesce("population", F.lit(0)) >= min_pop)
    return semi(p, geoids, ["geoid"]) if geoids is not None else p


def plan_items(places: DataFrame, work: DataFrame, categories: list[str] | None = None, limit: int | None = None, **where) -> DataFrame:
    """New items for the selected places; a pass only suits its own kind of place.

    Categories are a literal array to explode, so this is no join.
    """
    cats = categories or fixed.WORK_CATEGORIES
    picked = most_populous(select_places(places, **where), limit)
    rows = picked.withColumn("category", F.explode(F.array(*[F.lit(x) for x in cats])))
    need = choose(fixed.PASS_KIND, c("category"))
    rows = rows.where(need.isNull() | (need == c("kind"))).select(
        *ITEM, priority(c("kind"), c("population")).alias("priority"), F.lit("pending").alias("status"))
    return anti(rows, work, ITEM)


def claim(work: DataFrame, facts: DataFrame, places: DataFrame, n: int, max_attempts: int | None = None,
          states=None, kinds=None, categories=None, min_pop=0) -> DataFrame:
    """The next items to work on, with the state they move to."""
    w = anti(work.where(c("status") == "pending"), bulk_answered(facts), ITEM)
    p = select_places(places, states, kinds or fixed.KINDS, min_pop).select("geoid")
    w = semi(w, p, ["geoid"])
    if categories:
        w = w.where(c("category").isin(categories))
    if max_attempts:
        w = w.where(c("attempts") < max_attempts)
    return w.orderBy(c("priority").desc(), "geoid", "category").limit(n) \
        .withColumn("status", F.lit("in_progress")).withColumn("attempts", c("attempts") + 1)


def file_bulk_covered(work: DataFrame, facts: DataFrame, as_of_ts: str, pairs: DataFrame | None = None) -> DataFrame:
    """I4: open items an adapter already answered become complete."""
    w = flag_in(work, bulk_answered(facts), ITEM, "_bulk")
    hit = c("_bulk") & c("status").isin("pending", "in_progress", "needs_review")
    if pairs is not None:
        w = flag_in(w, pairs, ITEM, "_in")
        hit = hit & c("_in")
    now = F.lit(as_of_ts).cast("timestamp_ntz")
    w = w.withColumn("_hit", hit)
    return w.withColumn("status", F.when(c("_hit"), "complete").otherwise(c("status"))) \
        .withColumn("last_error", F.when(c("_hit"), fixed.BULK_NOTE).otherwise(c("last_error"))) \
        .withColumn("completed_at", F.when(c("_hit"), F.coalesce("completed_at", now)).otherwise(c("completed_at"))) \
        .drop("_hit", "_bulk", "_in")


def block_exhausted(work: DataFrame, max_attempts: int) -> DataFrame:
    """Pending items out of attempts are blocked, with a note."""
    out = (c("status") == "pending") & (c("attempts") >= max_attempts)
    note = F.concat(F.coalesce("last_error", F.lit("")), F.lit(" | gave up after "), c("attempts").cast("string"),
                    F.lit(" attempts; needs a source by hand"))
    return work.withColumn("last_error", F.when(out, note).otherwise(c("last_error"))) \
        .withColumn("status", F.when(out, "blocked").otherwise(c("status")))


def release_stale(work: DataFrame, as_of_ts: str, hours: int = 24) -> DataFrame:
    """Items in progress for too long go back to pending."""
    edge = F.lit(as_of_ts).cast("timestamp_ntz") - F.expr(f"interval {int(hours)} hours")
    late = (c("status") == "in_progress") & (c("claimed_at") < edge)
    return work.withColumn("status", F.when(late, "pending").otherwise(c("status")))


def requeue_stale(work: DataFrame, facts: DataFrame, as_of_ts: str, days: int = 365, n: int = 500) -> DataFrame:
    """The n most urgent long-finished items, reset for a fresh look."""
    edge = F.lit(as_of_ts).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
    old = work.where(c("status").isin("complete", "no_data") & (c("completed_at") < edge))
    pick = anti(old, bulk_answered(facts), ITEM).orderBy(c("priority").desc(), "geoid", "category").limit(n)
    return pick.withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0).cast("long")) \
        .withColumn("last_error", F.lit(f"refresh: last researched more than {int(days)} days ago"))


def unplanned(places: DataFrame, work: DataFrame, categories: list[str], n: int = 250, **where) -> DataFrame:
    """I8: places missing at least one category, most populous first."""
    have = work.where(c("category").isin(categories)).groupBy("geoid").agg(F.countDistinct("category").alias("planned"))
    p = select_places(places, **where).join(have, "geoid", "left").fillna(0, ["planned"])
    return most_populous(p.where(c("planned") < len(categories)), n).select("geoid", "kind", "population", "planned")


def states_missing_pass(places: DataFrame, work: DataFrame, pass_name: str) -> DataFrame:
    """States where a place of the pass's kind has no item for it."""
    p = places.where(c("kind") == fixed.PASS_KIND.get(pass_name, "state"))
    return anti(p, work.where(c("category") == pass_name), ["geoid"]).select("state_usps").distinct()


def apply_status(work: DataFrame, changes: DataFrame, as_of_ts: str) -> DataFrame:
    """Apply (geoid, category, status, error, outage) changes.

    Only complete and no_data set completed_at; an outage gives the attempt back.
    """
    now = F.lit(as_of_ts).cast("timestamp_ntz")
    ch = changes.select(*ITEM, c("status").alias("_to"), c("error").alias("_err"), c("outage").alias("_out"))
    j = work.join(ch, ITEM, "left").withColumn("_hit", c("_to").isNotNull())
    back = F.when(F.coalesce(c("_out"), F.lit(False)), F.greatest(c("attempts") - 1, F.lit(0))).otherwise(c("attempts"))
    done = F.when(c("_to").isin("complete", "no_data"), now)
    return j.withColumn("status", F.coalesce("_to", "status")).withColumn("attempts", back) \
        .withColumn("last_error", F.when(c("_hit"), c("_err")).otherwise(c("last_error"))) \
        .withColumn("completed_at", F.when(c("_hit"), done).otherwise(c("completed_at"))) \
        .drop("_to", "_err", "_out", "_hit")


def state_needing_statutes(work: DataFrame, places: DataFrame, statutes: DataFrame, absent: list[str] | None = None) -> DataFrame:
    """The largest state with open framework work and no statute text."""
    w = work.where((c("category") == fixed.STATE_PASS) & c("status").isin("pending", "in_progress"))
    s = anti(w.join(places.select("geoid", "state_usps", "population"), "geoid"), statutes, ["state_usps"])
    if absent:
        s = s.where(~c("state_usps").isin(absent))
    return s.orderBy(F.coalesce("population", F.lit(0)).desc(), "state_usps").limit(1).select("state_usps")


def _listing(work, places): return work.join(places.select("geoid", "name", "state_usps", "kind", "population"), "geoid")


def review_queue(work: DataFrame, places: DataFrame, n: int = 40) -> DataFrame:
    """Items in review, most urgent first."""
    return _listing(work.where(c("status") == "needs_review"), places) \
        .orderBy(c("priority").desc(), "geoid", "category").limit(n).select(*ITEM, "name", "state_usps", "priority")


def human_inbox(work: DataFrame, places: DataFrame, n: int = 40) -> DataFrame:
    """Review plus blocked plus anything with an error."""
    w = work.where(c("status").isin("needs_review", "blocked") | (F.coalesce("last_error", F.lit("")) != ""))
    return _listing(w, places).orderBy(c("priority").desc(), "geoid", "category").limit(n) \
        .select(*ITEM, "status", "last_error", "priority", "name", "state_usps")


def queue_listing(work: DataFrame, places: DataFrame, state: str | None = None, status: str | None = None, n: int = 200) -> DataFrame:
    """I13."""
    w = _listing(work.where(c("status") == status) if status else work, places)
    w = w.where(c("state_usps") == state.upper()) if state else w
    return w.orderBy(c("priority").desc(), "geoid", "category").limit(n) \
        .select(*ITEM, "status", "priority", "attempts", "name", "state_usps")


def reconcile_batch(items: DataFrame, results: DataFrame) -> DataFrame:
    """Fold a finished batch into its items.

    Submitted items with a result become ready (a truncated or failed result
    carries an error); submitted ones without are failed and requeued; items
    applied before stay; results nobody asked for are 'unknown'.
    """
    r = results.select("custom_id", c("result_type").alias("_t"), "stop_reason", c("text").alias("_text")).withColumn("_r", F.lit(True))
    i = items.withColumn("_i", F.lit(True))
    j = i.join(r, "custom_id", "full")
    sub = F.coalesce(c("status") == "submitted", F.lit(False))
    ok = F.coalesce(c("_t") == "succeeded", F.lit(False))
    cut = ok & F.coalesce(c("stop_reason") == "max_tokens", F.lit(False))
    change = (F.when(c("_i").isNull(), "unknown").when(sub & c("_r").isNotNull(), "landed").when(sub, "orphaned")
              .when(c("_r").isNotNull(), "already_applied").otherwise("untouched"))
    err = (F.when(c("change") == "orphaned", "no result returned for this item")
           .when((c("change") == "landed") & cut, "batch result truncated at the output cap")
           .when((c("change") == "landed") & ~ok, F.concat(F.lit("batch result "), c("_t"))).otherwise(c("error")))
    return j.withColumn("change", change).select(
        "custom_id", "geoid", "category", "change",
        F.when(c("change") == "landed", "ready").when(c("change") == "orphaned", "failed").otherwise(c("status")).alias("status"),
        err.alias("error"), F.when((c("change") == "landed") & ok & ~cut, c("_text")).alias("raw_response"),
        F.when(c("change") == "orphaned", "pending").alias("item_status"))


def batch_tallies(applied: DataFrame) -> DataFrame:
    """Done / empty / failed per batch."""
    return applied.groupBy("batch_id").agg(*[F.count_if(c("outcome") == o).alias(o) for o in ("done", "empty", "failed")])


def return_parked(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I16: batch reading is off: queued items fail, their work goes back to pending."""
    q = c("status") == "queued"
    after = items.withColumn("error", F.when(q, "batch mode turned off before submission").otherwise(c("error"))) \
        .withColumn("status", F.when(q, "failed").otherwise(c("status")))
    changes = items.where(q).select(*ITEM, F.lit("pending").alias("status"),
                                    F.lit("batch mode turned off; queued for live reading").alias("error"), F.lit(False).alias("outage"))
    return after, changes


def close_orphans(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs left running end at their last page, else at their start."""
    last = pages.groupBy("run_id").agg(F.max("fetched_at").alias("_last"))
    j = runs.join(last, "run_id", "left")
    orphan = c("status") == "running"
    return j.select("run_id", "started_at", F.when(orphan, "failed").otherwise(c("status")).alias("status"),
                    F.when(orphan, F.coalesce("_last", "started_at")).otherwise(c("finished_at")).alias("finished_at"))
