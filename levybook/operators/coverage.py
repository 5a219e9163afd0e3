"""Coverage and progress analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import choose
from ..functions.scan import anti, first_rows, flag_in, latest, semi
from .views import live

c = F.col
ITEM = ["geoid", "category"]
DONE = ["complete", "no_data"]


def _pop() -> Column: return F.coalesce("population", F.lit(0))
def _placed(work, places): return work.join(places.select("geoid", "state_usps", "kind", "name", "population"), "geoid")


def coverage_pivot(work: DataFrame, places: DataFrame) -> DataFrame:
    """Six status counts, total and population done by state, kind and category."""
    states = ["complete", "needs_review", "in_progress", "pending", "no_data", "blocked"]
    return _placed(work, places).groupBy("state_usps", "kind", "category").agg(
        *[F.count_if(c("status") == s).alias(s) for s in states], F.count("*").alias("total"),
        F.sum(F.when(c("status") == "complete", _pop()).otherwise(0)).alias("pop_complete"), F.sum(_pop()).alias("pop_total"))


def status_by_state(work: DataFrame, places: DataFrame) -> DataFrame:
    """J2."""
    return _placed(work, places).groupBy("state_usps", "status").agg(F.count("*").alias("n"), F.sum(_pop()).alias("pop"))


def state_progress(work: DataFrame, places: DataFrame) -> DataFrame:
    """Items done per state, in percent, and population-weighted."""
    done = c("status").isin(DONE)
    g = _placed(work, places).groupBy("state_usps").agg(
        F.count("*").alias("items"), F.count_if(done).alias("done"),
        F.sum(F.when(done, _pop()).otherwise(0)).alias("_pd"), F.sum(_pop()).alias("_pt"))
    return g.select("state_usps", "items", "done", F.round(100.0 * c("done") / c("items"), 1).alias("done_pct"),
                    F.when(c("_pt") > 0, F.round(100.0 * c("_pd") / c("_pt"), 2)).alias("pop_pct"))


def status_shares(work: DataFrame) -> DataFrame:
    """Share of each status; the counts are few, so the total is a window over them."""
    from pyspark.sql import Window
    g = work.groupBy("status").agg(F.count("*").alias("n"))
    return g.withColumn("share_pct", F.round(100.0 * c("n") / F.sum("n").over(Window.partitionBy()), 1))


def places_by_kind(places: DataFrame) -> DataFrame:
    """J3."""
    return places.groupBy("kind").agg(F.count("*").alias("n"), F.sum(_pop()).alias("pop"))


def project_progress(work: DataFrame, places: DataFrame) -> DataFrame:
    """Places and people covered, and state passes done, in one row."""
    local = places.where(c("kind").isin("county", "place"))
    done = work.where(c("status") == "complete").select("geoid").distinct()
    p = flag_in(local, done, ["geoid"], "_done").agg(
        F.sum(_pop()).alias("pop_total"), F.sum(F.when(c("_done"), _pop()).otherwise(0)).alias("pop_done"),
        F.count("*").alias("juris_total"), F.count_if(c("_done")).alias("juris_done"))
    s = places.where(c("kind") == "state").agg(F.count("*").alias("states_total"))
    f = semi(work.where((c("category") == fixed.STATE_PASS) & (c("status") == "complete")), places, ["geoid"]) \
        .agg(F.count("*").alias("states_done"))
    # Three one-row frames side by side: stacked, then folded into one row.
    stacked = p.unionByName(s, allowMissingColumns=True).unionByName(f, allowMissingColumns=True)
    one = stacked.agg(*[F.max(x).alias(x) for x in stacked.columns])
    return one.withColumn("pop_pct", F.when(c("pop_total") > 0, F.round(100.0 * c("pop_done") / c("pop_total"), 1)).otherwise(0.0))


def coverage_for(asked: DataFrame, assertions: DataFrame, domain: str = "ballot_measure") -> DataFrame:
    """The assertion that speaks for a place: its own, else its county's, else its state's.

    Assertions are reduced to the best per scope first (most complete, then
    newest), so a state's row is joined, never fanned out.
    """
    order = choose({v: i for i, v in enumerate(fixed.COMPLETENESS_ORDER, start=1)}, c("completeness"))
    best = latest(assertions.where(c("domain") == domain), ["scope_geoid"],
                  [-F.coalesce(order, F.lit(5)), c("asserted_seq")], ["completeness"])
    out = asked
    for name in ("geoid", "county_fips", "state_fips"):
        b = best.select(c("scope_geoid").alias(name), c("completeness").alias(f"_c_{name}"))
        out = out.join(b, name, "left")
    found = F.coalesce("_c_geoid", "_c_county_fips", "_c_state_fips")
    scope = (F.when(c("_c_geoid").isNotNull(), c("geoid")).when(c("_c_county_fips").isNotNull(), c("county_fips"))
             .when(c("_c_state_fips").isNotNull(), c("state_fips")))
    return out.select("geoid", scope.alias("scope_geoid"), found.alias("completeness"))


def list_assertions(assertions: DataFrame, places: DataFrame, domain: str | None = None, completeness: str | None = None) -> DataFrame:
    """J6."""
    a = assertions.where(c("domain") == domain) if domain else assertions
    a = a.where(c("completeness") == completeness) if completeness else a
    p = places.select(c("geoid").alias("scope_geoid"), "name", "state_usps")
    return a.join(p, "scope_geoid", "left").select("domain", "scope_type", "scope_geoid", "completeness", "name", "state_usps")


def completeness_histogram(assertions: DataFrame, domain: str | None = None) -> DataFrame:
    """J6."""
    a = assertions.where(c("domain") == domain) if domain else assertions
    return a.groupBy("completeness").agg(F.count("*").alias("n"))


def newest_verdicts(checks: DataFrame) -> DataFrame:
    return latest(checks, ITEM, [c("id")], ["verdict"])


def auto_verified(checks: DataFrame) -> DataFrame:
    """Items whose newest verdict is a pass."""
    return newest_verdicts(checks).where(c("verdict") == "pass").select(*ITEM)


def header_counters(tables: dict[str, DataFrame], work: DataFrame, facts: DataFrame, checks: DataFrame, runs: DataFrame) -> DataFrame:
    """Counters over many tables; each table is counted once, in one pass."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("metric"), "n") for k, df in tables.items()]
    st = {"work_items": F.lit(True), "pending": c("status") == "pending", "in_progress": c("status") == "in_progress",
          "needs_review": c("status") == "needs_review", "blocked": c("status") == "blocked",
          "awaiting_ai": c("status") == "awaiting_ai", "done": c("status").isin(DONE)}
    w = work.agg(*[F.count_if(p).alias(k) for k, p in st.items()])
    counts.append(w.select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("metric"), c(k).alias("n")) for k in st])).alias("_p", "s"))
                  .select("s.metric", "s.n"))
    for k, df in (("instruments", live(facts)), ("auto_verified", auto_verified(checks)),
                  ("runs_active", runs.where(c("status") == "running"))):
        counts.append(df.agg(F.count("*").alias("n")).select(F.lit(k).alias("metric"), "n"))
    out = counts[0]
    for d in counts[1:]:
        out = out.unionByName(d)
    return out


def week(work: DataFrame, checks: DataFrame, pages: DataFrame, as_of_ts: str, days: int = 7) -> DataFrame:
    """Items published, checks flagged and pages fetched in the trailing days."""
    edge = F.lit(as_of_ts).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
    parts = [("published", work.where((c("status") == "complete") & (c("completed_at") >= edge))),
             ("flagged", checks.where((c("verdict") == "flag") & (c("created_at") >= edge))),
             ("pages", pages.where(c("fetched_at") >= edge))]
    out = None
    for k, d in parts:
        one = d.agg(F.count("*").alias("n")).select(F.lit(k).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def finished_since(work: DataFrame, edge_ts: str) -> DataFrame:
    """J9."""
    return work.where((c("status") == "complete") & (c("completed_at") >= F.lit(edge_ts).cast("timestamp_ntz"))) \
        .agg(F.count("*").alias("finished"))


CHIPS = {"review": ["needs_review"], "published": ["complete"], "working": ["pending", "in_progress", "awaiting_ai"],
         "none": ["no_data"], "stuck": ["blocked"]}


def _search(rows, q):
    if not q:
        return rows
    return rows.where(c("name").ilike(f"%{q}%") | (c("geoid") == q) | (c("state_usps") == q.upper()))


def record_chips(work: DataFrame, places: DataFrame, q: str = "") -> DataFrame:
    """Counts per status group under a search."""
    g = _search(_placed(work, places), q).groupBy("status").agg(F.count("*").alias("n"))
    aggs = [F.sum("n").alias("all")] + [F.sum(F.when(c("status").isin(v), c("n")).otherwise(0)).alias(k) for k, v in CHIPS.items()]
    one = g.agg(*aggs)
    keys = ["all", *CHIPS]
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("chip"), F.coalesce(c(k), F.lit(0)).alias("n")) for k in keys])).alias("s")) \
        .select("s.chip", "s.n")


def record_page(work: DataFrame, places: DataFrame, facts: DataFrame, q: str = "", chip: str = "all", page: int = 1, per_page: int = 50) -> DataFrame:
    """One page of items by population, with the first live rate of each."""
    rows = _search(_placed(work, places), q)
    if chip in CHIPS:
        rows = rows.where(c("status").isin(CHIPS[chip]))
    rows = rows.orderBy(c("population").desc_nulls_last(), "name", "geoid", "category").offset((page - 1) * per_page).limit(per_page)
    rated = semi(live(facts).where(c("rate_value").isNotNull()), rows, ITEM)
    first = rated.groupBy(*ITEM).agg(F.min_by(F.struct("rate_value", "rate_unit"), F.struct("instrument_code", "id")).alias("_r"))
    return rows.join(first, ITEM, "left").select(*ITEM, "name", "state_usps", "kind", "status", c("_r.rate_value").alias("rate_value"),
                                                  c("_r.rate_unit").alias("rate_unit"))


def review_details(work: DataFrame, places: DataFrame, facts: DataFrame, sources: DataFrame, checks: DataFrame, n: int = 40) -> DataFrame:
    """The n most urgent reviews with the rate in question, what it replaced and the newest verdict."""
    items = _placed(work.where(c("status") == "needs_review"), places).orderBy(c("priority").desc(), "geoid", "category").limit(n) \
        .select(*ITEM, "name", "state_usps", "priority")
    mine = semi(facts, items, ITEM)
    head = first_rows(live(mine), ITEM, [c("rate_value").isNull(), c("instrument_code"), c("id")]) \
        .select(*ITEM, "instrument_code", "rate_value", "rate_unit", "source_id")
    prior = latest(mine.where(c("superseded_by").isNotNull()), [*ITEM, "instrument_code"], [c("seq")],
                   ["rate_value", "rate_unit"]).withColumnRenamed("rate_value", "previous_value").withColumnRenamed("rate_unit", "previous_unit")
    s = sources.select(c("id").alias("source_id"), c("url").alias("source_url"), "authority_tier")
    return items.join(head, ITEM, "left").join(prior, [*ITEM, "instrument_code"], "left").join(s, "source_id", "left") \
        .join(newest_verdicts(checks), ITEM, "left").drop("source_id")


def ask_first(kind: Column, category: Column) -> Column:
    """The instruments worth asking about first, as a literal lookup."""
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    out = F.when((category == "sales_use") & (kind == "county"), arr(fixed.ASK_FIRST_SALES["county"])) \
        .when((category == "sales_use") & (kind == "place"), arr(fixed.ASK_FIRST_SALES["place"])) \
        .when(category == "sales_use", arr(fixed.ASK_FIRST_SALES["*"]))
    for k, v in fixed.ASK_FIRST.items():
        out = out.when(category == k, arr(v))
    return out


def gap_list(work: DataFrame, places: DataFrame, facts: DataFrame, answers: DataFrame, as_of_ts: str, hours: int = 12) -> DataFrame:
    """Expected instruments an item lacks a complete, confident live row for, with the reason.

    Instruments answered or skipped in the last hours are left out.
    """
    w = work.where(c("category").isin(fixed.TAX_CATEGORIES)).join(places.select("geoid", "kind"), "geoid")
    asked = w.withColumn("instrument_code", F.explode(ask_first(c("kind"), c("category")))).select(*ITEM, "instrument_code", "last_error")
    key = [*ITEM, "instrument_code"]
    f = live(facts).select(*key, "status", "rate_value", "confidence", F.lit(True).alias("_on_file"))
    edge = F.lit(as_of_ts).cast("timestamp_ntz") - F.expr(f"interval {int(hours)} hours")
    settled = answers.where(c("action").isin("skipped", "skip_rest", "answered", "unknown") & (c("created_at") >= edge))
    j = anti(asked, settled, key).join(f, key, "left")
    reason = (F.when(c("_on_file").isNull(), "nothing_on_file").when(c("status") == "unknown", "unknown")
              .when((c("status") == "levied") & c("rate_value").isNull(), "levied_without_rate")
              .when(c("confidence") == "low", "low_confidence"))
    complete = ((c("status") == "levied") & (c("rate_value").isNotNull() | c("instrument_code").isin(fixed.RATELESS_INSTRUMENTS))) | \
        c("status").isin("authorized_not_levied", "prohibited", "repealed")
    keep = ~F.coalesce(complete, F.lit(False)) | (c("confidence") == "low")
    return j.where(keep).withColumn("reason", reason).where(c("reason").isNotNull()).select(
        *key, "reason", F.when(c("_on_file").isNull(), c("last_error")).alias("note"))


def citations(places: DataFrame, uploads: DataFrame, pages: DataFrame, sources: DataFrame, agencies: DataFrame,
              n_uploads: int = 8, n_pages: int = 8, n_sources: int = 6) -> DataFrame:
    """What can be cited for a place: uploads, pages, sources, agency; one row per URL, first origin wins."""
    def part(df, origin, rank):
        return df.select("geoid", "url", F.lit(origin).alias("origin"), F.lit(rank).alias("_o"), c("_rk"))
    u = part(first_rows(uploads, ["geoid"], [c("id").desc()], n_uploads, "_rk"), "intake", 0)
    p = part(first_rows(pages.where(~c("url").startswith("file:")), ["geoid"], [c("id").desc()], n_pages, "_rk"), "crawl", 1)
    s = part(first_rows(sources.withColumnRenamed("scope_geoid", "geoid").where(c("geoid").isNotNull()), ["geoid"],
                        [c("authority_tier"), c("id")], n_sources, "_rk"), "catalog", 2)
    a = part(places.join(agencies.select("state_usps", "url"), "state_usps").withColumn("_rk", F.lit(1)), "agency", 3)
    allc = u.unionByName(p).unionByName(s).unionByName(a).where(F.coalesce("url", F.lit("")) != "")
    one = latest(allc, ["geoid", "url"], [-c("_o"), -c("_rk")], ["origin"])
    return one


def urgent_names(work: DataFrame, places: DataFrame, n: int = 3) -> DataFrame:
    """Names of the most urgent reviews, each name once."""
    g = _placed(work.where(c("status") == "needs_review"), places).groupBy("name").agg(F.max("priority").alias("priority"))
    return g.orderBy(c("priority").desc(), "name").limit(n)


def newest_blocked(work: DataFrame, places: DataFrame, n: int = 3) -> DataFrame:
    """J14."""
    return _placed(work.where(c("status") == "blocked"), places).orderBy(c("updated_at").desc(), "geoid", "category").limit(n) \
        .select(*ITEM, "name", "state_usps", "updated_at")


def _top(df, keys, order, k, value: Column, name):
    """At most k values per key, gathered in order."""
    t = first_rows(df, keys, order, k, "_rk")
    g = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(c("_rk"), value.alias("v")))).alias("_l"))
    return g.select(*keys, F.transform("_l", lambda s: s["v"]).alias(name))


def _scopes(items: DataFrame) -> DataFrame:
    """Item rows once per scope they draw on (own, county, state)."""
    return items.withColumn("scope_geoid", F.explode(F.array_distinct(F.array_compact(F.array("geoid", "county_fips", "state_fips")))))


def research_context(items: DataFrame, places: DataFrame, facts: DataFrame, sources: DataFrame, bases: DataFrame,
                     statute_hits: DataFrame, profiles: DataFrame, n_facts: int = 60, n_sources: int = 25) -> DataFrame:
    """What is known for each tax item, in one nested row.

    Facts and sources by tier over three scopes are listings of ``n_facts`` and
    ``n_sources``; collections and the state's statute hits are given whole.
    """
    it = items.where(c("category").isin(fixed.TAX_CATEGORIES)).join(
        places.select("geoid", "state_usps", "state_fips", "county_fips"), "geoid")
    fact = F.concat_ws(" ", "instrument_code", "status", c("rate_value").cast("string"), "rate_unit")
    known = _top(live(facts), ITEM, [c("instrument_code"), c("id")], n_facts, fact, "known")
    # Sources depend on the place only: rank them once per place.
    scoped = _scopes(it.select("geoid", "county_fips", "state_fips").distinct()).join(
        first_rows(sources.where(c("scope_geoid").isNotNull()), ["scope_geoid"], [c("authority_tier"), c("id")], n_sources), "scope_geoid")
    src = _top(scoped, ["geoid"], [c("authority_tier"), c("id")], n_sources, c("url"), "sources")
    # one row per place, year and type: as many as the place has reported
    prior = bases.groupBy("geoid").agg(F.array_sort(F.collect_list(F.struct("fiscal_year", "base_type", "base_value"))).alias("_l")) \
        .select("geoid", F.transform("_l", lambda b: F.concat_ws("=", F.concat_ws(" ", b["fiscal_year"].cast("string"), b["base_type"]), b["base_value"].cast("string"))).alias("priors"))
    prof = profiles.select("state_usps", c("home_rule_doctrine").alias("doctrine"))
    empty = F.array().cast("array<string>")
    return it.join(known, ITEM, "left").join(src, ["geoid"], "left").join(prior, ["geoid"], "left") \
        .join(statute_hits, ["state_usps", "category"], "left").join(prof, "state_usps", "left") \
        .select(*ITEM, "state_usps", "doctrine", *[F.coalesce(x, empty).alias(x) for x in ("known", "sources", "priors", "statutes")])


def framework_context(items: DataFrame, places: DataFrame, thresholds: DataFrame, grants: DataFrame, sources: DataFrame,
                      n_rules: int = 40, n_sources: int = 30) -> DataFrame:
    """State items with listings of ``n_rules`` thresholds and grants and ``n_sources`` sources, and the full counts."""
    it = items.where(c("category") == fixed.STATE_PASS).join(places.where(c("kind") == "state").select("geoid", "state_usps"), "geoid")
    th = _top(thresholds, ["state_usps"], [c("measure_class"), c("id")], n_rules,
              F.concat_ws(" ", "measure_class", F.coalesce("jurisdiction_kind", F.lit("any")), c("threshold_value").cast("string")), "thresholds")
    gr = _top(grants, ["state_usps"], [c("category"), c("id")], n_rules,
              F.concat_ws(" ", "category", "instrument_code", "permitted"), "grants")
    sr = _top(sources.where(c("scope_geoid").isNotNull()).withColumnRenamed("scope_geoid", "geoid"), ["geoid"],
              [c("authority_tier"), c("id")], n_sources, c("url"), "sources")
    n_t = thresholds.groupBy("state_usps").agg(F.count("*").alias("n_thresholds"))
    n_g = grants.groupBy("state_usps").agg(F.count("*").alias("n_grants"))
    j = it.join(th, "state_usps", "left").join(gr, "state_usps", "left").join(sr, "geoid", "left") \
        .join(n_t, "state_usps", "left").join(n_g, "state_usps", "left")
    empty = F.array().cast("array<string>")
    return j.select("geoid", "state_usps", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_thresholds", "n_grants")],
                    *[F.coalesce(x, empty).alias(x) for x in ("thresholds", "grants", "sources")])


def elections_context(items: DataFrame, places: DataFrame, measures: DataFrame, live_rules: DataFrame, sources: DataFrame,
                      n_measures: int = 40, n_rules: int = 40, n_sources: int = 20) -> DataFrame:
    """County items with listings of measures, the state's live thresholds, and sources."""
    it = items.where(c("category") == fixed.COUNTY_PASS).join(places.select("geoid", "state_usps", "state_fips"), "geoid")
    ms = _top(live(measures), ["geoid"], [c("election_date").desc(), c("id").desc()], n_measures,
              F.concat_ws(" ", "election_date", "measure_class", "outcome"), "measures")
    th = _top(live_rules, ["state_usps"], [c("measure_class"), c("id")], n_rules,
              F.concat_ws(" ", "measure_class", c("threshold_value").cast("string")), "thresholds")
    per = first_rows(sources.where(c("scope_geoid").isNotNull()), ["scope_geoid"], [c("authority_tier"), c("id")], n_sources)
    two = it.select("geoid", F.explode(F.array("geoid", "state_fips")).alias("scope_geoid")).join(per, "scope_geoid")
    sr = _top(two, ["geoid"], [c("authority_tier"), c("id")], n_sources, c("url"), "sources")
    empty = F.array().cast("array<string>")
    return it.join(ms, "geoid", "left").join(th, "state_usps", "left").join(sr, "geoid", "left") \
        .select("geoid", "state_usps", *[F.coalesce(x, empty).alias(x) for x in ("measures", "thresholds", "sources")])


def packets(claimed: DataFrame) -> DataFrame:
    """Claimed items per place; the two passes stay on their own."""
    is_pass = c("category").isin(fixed.STATE_PASS, fixed.COUNTY_PASS)
    tax = claimed.where(~is_pass).groupBy("geoid").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    return tax.unionByName(claimed.where(is_pass).select("geoid", F.array("category").alias("categories")))


def item_sources(items: DataFrame, places: DataFrame, sources: DataFrame, pages: DataFrame, deals: int = 64) -> DataFrame:
    """Sources that seed an item: own, county or state scope, untagged or tagged with its category.

    ``covered`` tells that a tagged source answers the item, ``crawled`` that a page of it was fetched before.
    Both are settled on items and scopes, so the pairs come last and are not shuffled. A
    scope's items are dealt over ``deals`` tasks, each with the scope's sources; these copies
    are sorted and merged, as their size is not in the estimate that chooses a broadcast.
    """
    it = items.join(places.select("geoid", "state_fips", "county_fips"), "geoid")
    s = sources.where(c("scope_geoid").isNotNull()).select(
        "scope_geoid", "url", "authority_tier", F.explode_outer(F.array_distinct(F.split("categories", ","))).alias("tag"))
    tagged = s.where(c("tag").isNotNull()).select("scope_geoid", c("tag").alias("category")).distinct().withColumn("_tagged", F.lit(True))
    scoped = _scopes(it).select(*ITEM, "scope_geoid")
    cov = scoped.join(tagged, ["scope_geoid", "category"]).select(*ITEM).distinct().withColumn("covered", F.lit(1))
    crawled = pages.select(*ITEM).distinct().withColumn("crawled", F.lit(1))
    marked = scoped.join(cov, ITEM, "left").join(crawled, ITEM, "left")
    marked = marked.withColumn("_deal", F.pmod(F.xxhash64(*ITEM), F.lit(deals)).cast("int")).repartition(deals, "scope_geoid", "_deal")
    dealt = s.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    hit = marked.join(dealt.hint("merge"), ["scope_geoid", "_deal"]).where(c("tag").isNull() | (c("tag") == c("category")))
    return hit.select(*ITEM, "url", "authority_tier", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("crawled", F.lit(0)).alias("crawled"))
