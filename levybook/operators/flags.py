"""Plausibility flags and verdict routing.

Flags are ``array<struct<code, label, reason, hard>>`` built in one projection; a
hard flag is a contradiction, a soft one a concern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import choose, contains_any, lit_dim, loose, url_host
from ..functions.scan import first_rows, latest, semi

c = F.col


def _flags(label: Column, rules: list[tuple[str, bool, Column, str]]) -> Column:
    hits = [F.when(F.coalesce(p, F.lit(False)),
                   F.struct(F.lit(code).alias("code"), label.cast("string").alias("label"),
                            F.lit(why).alias("reason"), F.lit(hard).alias("hard")))
            for code, hard, p, why in rules]
    return F.filter(F.array(*hits), lambda f: f.isNotNull())


def host_state(df: DataFrame, spark, url: str = "url", out: str = "host_state") -> DataFrame:
    """H7: the state whose own .gov site serves a URL, by code or by spelled-out name."""
    states = lit_dim(spark, [(u.lower(), u) for _, u, _ in fixed.STATES if u not in fixed.CODES_NOT_IN_HOSTS]
                     + [(n.lower().replace(" ", ""), u) for _, u, n in fixed.STATES], "_second string, _usps string")
    host = url_host(c(url))
    second = F.when(host.rlike(r"(^|\.)[^.]+\.gov$"), F.regexp_extract(host, r"([^.]+)\.gov$", 1))
    return df.withColumn("_second", second).join(states, "_second", "left") \
        .withColumn(out, c("_usps")).drop("_second", "_usps")


def rate_flags(rows: DataFrame, as_of: str | None = None) -> DataFrame:
    """H1: adds ``flags`` to live rate rows.

    Besides fact columns the rows carry prev_as_of (H4), own_state, kind,
    state_rate (H6), src_state (H7) and doc_norm, the item's text in ``loose``
    form (null when there is none).
    """
    quote = F.trim(F.coalesce("source_quote", F.lit("")))
    bulk = F.coalesce(c("extraction_method") == "bulk_import", F.lit(False))
    said = loose(F.concat_ws(" ", F.coalesce("label", F.lit("")), quote))
    rate, unit, prev = c("rate_value"), c("rate_unit"), F.substring("prev_as_of", 1, 10)
    dated, eff = c("prev_as_of").isNotNull(), F.when(c("effective_date") != "", F.substring("effective_date", 1, 10))
    lo = choose({k: v[0] for k, v in fixed.PLAUSIBLE_RANGE.items()}, unit)
    hi = choose({k: v[1] for k, v in fixed.PLAUSIBLE_RANGE.items()}, unit)
    older = (eff < prev) | (eff.isNull() & (c("fiscal_year") < F.substring(prev, 1, 4).try_cast("int")))
    rules = [
        ("no_quote", False, (quote == "") & ~bulk, "nothing quoted to verify against"),
        ("quote_missing", False, (quote != "") & (F.coalesce("doc_norm", F.lit("")) != "")
         & ~c("doc_norm").contains(loose(quote)), "quote not found in the page text"),
        ("not_a_tax", True, contains_any(said, fixed.NOT_A_TAX_TERMS), "reads like an allowance or reimbursement"),
        ("implausible_rate", True, (rate < lo) | (rate > hi), "rate outside the plausible range of its unit"),
        ("status_conflict", True, (c("status") == "prohibited") & rate.isNotNull(), "prohibited, yet has a rate"),
        ("over_cap", True, (c("cap_unit").eqNullSafe(unit)) & (rate > c("cap_value")), "rate above its own cap"),
        ("low_confidence", False, c("confidence") == "low", "extracted with low confidence"),
        ("cross_reference", False, quote.rlike(fixed.SEE_ELSEWHERE_PATTERN), "quote points somewhere else"),
        ("combined_rate", False, (c("category") == "sales_use") & (unit == "percent") & (rate >= c("state_rate")),
         "at or above the state's own rate"),
        ("wrong_state_source", True, ~bulk & (c("kind") != "state") & (c("src_state") != F.upper("own_state")),
         "served from another state's site"),
        ("date_regression", True, dated & older, "older than the row it replaced"),
        ("undated_supersede", True, dated & eff.isNull() & c("fiscal_year").isNull(), "undated row replaced a dated one"),
    ]
    return rows.withColumn("flags", _flags(c("instrument_code"), rules))


def measure_flags(rows: DataFrame, as_of: str) -> DataFrame:
    """H2: adds ``flags`` to measures (authority_tier and doc_norm joined)."""
    label = F.coalesce(F.when(c("measure_id_local") != "", c("measure_id_local")), c("election_date"))
    rules = [
        ("no_result", True, c("votes_total").isNull() & c("pct_yes").isNull(), "no counts and no percentage"),
        ("no_threshold", False, c("threshold_required").isNull(), "no threshold on file"),
        ("outcome_unknown", False, c("outcome") == "unknown", "outcome unknown"),
        ("low_confidence", False, c("confidence") == "low", "extracted with low confidence"),
        ("weak_source", False, F.coalesce("authority_tier", F.lit(4)) >= 4, "only an aggregator"),
        ("id_missing", False, (F.coalesce("doc_norm", F.lit("")) != "") & (c("measure_id_local") != "")
         & ~c("doc_norm").contains(loose(c("measure_id_local"))), "identifier not in the page text"),
        ("future_result", True, (c("election_date") > as_of) & c("outcome").isin("passed", "failed"),
         "result of an election still to come"),
    ]
    return rows.withColumn("flags", _flags(label, rules))


def framework_flags(rows: DataFrame) -> DataFrame:
    """H3: adds ``flags`` to thresholds and grants (columns of the other kind are null)."""
    tv = c("threshold_value")
    rules = [
        ("threshold_scale", True, tv <= 1.0, "threshold looks like a fraction"),
        ("threshold_low", False, (tv > 1.0) & (tv < 50.0), "below a simple majority"),
        ("no_cap", False, (c("permitted") == "yes") & c("max_rate").isNull(), "permitted without a maximum"),
        ("no_cite", False, F.coalesce("statute_cite", F.lit("")) == "", "no cite"),
        ("cite_missing", False, (c("statute_cite") != "") & (F.coalesce("doc_norm", F.lit("")) != "")
         & ~c("doc_norm").contains(loose(c("statute_cite"))), "cite not in the page text"),
        ("low_confidence", False, c("confidence") == "low", "extracted with low confidence"),
        ("weak_source", False, F.coalesce("authority_tier", F.lit(4)) >= 4, "only an aggregator"),
    ]
    return rows.withColumn("flags", _flags(c("label"), rules))


def explode_flags(flagged: DataFrame, keys: list[str]) -> DataFrame:
    return flagged.select(*keys, F.posexplode("flags").alias("flag_pos", "f")) \
        .select(*keys, "flag_pos", "f.code", "f.label", "f.reason", "f.hard")


def with_displaced_date(facts: DataFrame) -> DataFrame:
    """H4: live rows with ``prev_as_of``, the newest date among the rows each one displaced."""
    when = F.coalesce("effective_date", F.concat(c("fiscal_year").cast("string"), F.lit("-01-01")))
    gone = facts.where(c("superseded_by").isNotNull() & (c("superseded_by") != c("id"))) \
        .groupBy(c("superseded_by").alias("id")).agg(F.max(when).alias("prev_as_of"))
    return facts.where(c("superseded_by").isNull()).join(gone, "id", "left")


def newest_measures(measures: DataFrame, n: int | None = None) -> DataFrame:
    """H5: live measures per place, all of them or the newest n."""
    held = measures.where(c("superseded_by").isNull())
    return held if n is None else first_rows(held, ["geoid"], [c("election_date").desc(), c("id").desc()], n)


def newest_rules(thresholds: DataFrame, grants: DataFrame, n: int | None = None) -> DataFrame:
    """H5: thresholds and grants per state in one checkable list, all of them or the newest n of each."""
    null = F.lit(None)
    newest = lambda df: df if n is None else first_rows(df, ["state_usps"], [c("id").desc()], n)
    a = newest(thresholds).select(
        "state_usps", "id", c("measure_class").alias("label"), "threshold_value", null.cast("string").alias("permitted"),
        null.cast("double").alias("max_rate"), "statute_cite", "confidence", "authority_tier", F.lit("threshold").alias("rule_kind"))
    b = newest(grants).select(
        "state_usps", "id", c("instrument_code").alias("label"), null.cast("double").alias("threshold_value"), "permitted",
        "max_rate", "statute_cite", "confidence", "authority_tier", F.lit("grant").alias("rule_kind"))
    return a.unionByName(b)


def state_rates(facts: DataFrame, places: DataFrame) -> DataFrame:
    """H6: the highest live percent rate of each state itself, per category."""
    states = places.where(c("kind") == "state").select("geoid", c("state_usps").alias("own_state"))
    f = facts.where(c("superseded_by").isNull() & (c("rate_unit") == "percent") & c("rate_value").isNotNull())
    return f.join(states, "geoid").groupBy("own_state", "category").agg(F.max("rate_value").alias("state_rate"))


def with_place_context(rows: DataFrame, places: DataFrame, rates: DataFrame) -> DataFrame:
    """H6: adds own_state, kind and, below the state level, state_rate."""
    p = places.select("geoid", c("state_usps").alias("own_state"), "kind")
    j = rows.join(p, "geoid", "left").join(rates, ["own_state", "category"], "left")
    return j.withColumn("state_rate", F.when(c("kind") != "state", c("state_rate")))


def subject_rows(rows: DataFrame, claim_ids: DataFrame | None, item: list[str]) -> DataFrame:
    """H8: only the rows one ingest wrote; items it wrote nothing for keep all their rows."""
    if claim_ids is None:
        return rows
    wrote = semi(rows, claim_ids, ["id"])
    rest = rows.join(wrote.select(*item).distinct(), item, "left_anti")
    return wrote.unionByName(rest)


def excerpt(doc: Column, anchors: Column, max_chars: int, pad: int = 2000, head: int = 3000) -> Column:
    """H9: the head and the passages around each anchor's first hit, overlaps merged, cut at max_chars.

    Whole anchors are searched in the whole document.  Documents within max_chars are
    given whole, and those without a hit by their beginning.
    """
    n = F.length(doc)
    usable = F.filter(F.transform(anchors, lambda a: F.trim(F.coalesce(a, F.lit("")))), lambda a: F.length(a) >= 3)
    found = F.filter(F.transform(usable, lambda a: F.struct(
        F.position(a, doc).alias("p"), F.length(a).alias("l"))), lambda s: s["p"] > 0)
    around = F.transform(found, lambda s: F.struct(F.greatest(F.lit(0), s["p"] - 1 - pad).alias("s"),
                                                   F.least(n, s["p"] - 1 + s["l"] + pad).alias("e")))
    spans = F.array_sort(F.concat(F.array(F.struct(F.lit(0).alias("s"), F.least(F.lit(head), n).alias("e"))), around))
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def merge(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                          F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= F.try_element_at(acc, F.lit(-1))["e"]), joined).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(spans, none, merge)
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<string>)").alias("parts"))

    def take(acc, x):
        room = F.lit(max_chars) - acc["used"]
        part = F.substr(doc, x["s"] + 1, F.least(x["e"] - x["s"], room))
        return F.when(room <= 0, acc).otherwise(F.struct((acc["used"] + F.length(part)).alias("used"),
                                                         F.concat(acc["parts"], F.array(part)).alias("parts")))

    cut = F.array_join(F.aggregate(merged, start, take)["parts"], fixed.EXCERPT_SEPARATOR)
    plain = F.substring(doc, 1, max_chars)
    return F.when(doc.isNull(), F.lit("")).when((n <= max_chars) | (F.size(found) == 0), plain).otherwise(cut)


def route(items: DataFrame, flags: DataFrame, answers: DataFrame, failures: DataFrame, n_shown: int = 3) -> DataFrame:
    """Verdict, status and a short summary per item.

    ``items``: geoid, category, n_rows.  ``flags``: exploded flags.  ``answers``:
    one model verdict per row.  ``failures``: items whose second check failed.
    The summary lists the first ``n_shown`` hard flags and counts the rest.  A hard flag goes to review unseen by the model; a failed check or a missing
    verdict is an error; any verdict but 'pass' is a flag; else it is published.
    """
    key = ["geoid", "category"]
    f = flags.groupBy(*key).agg(F.count_if("hard").alias("n_hard"), F.count_if(~c("hard")).alias("n_soft"))
    not_pass = F.lower(F.trim(F.coalesce("verdict", F.lit("")))) != "pass"
    a = answers.groupBy(*key).agg(F.count("*").alias("n_answers"), F.count_if(not_pass).alias("n_against"))
    fail = failures.select(*key).distinct().withColumn("failed", F.lit(True))
    j = items.join(f, key, "left").join(a, key, "left").join(fail, key, "left").fillna(
        0, ["n_hard", "n_soft", "n_answers", "n_against"])
    verdict = (F.when(c("n_hard") > 0, "flag").when(c("failed") | (c("n_answers") < c("n_rows")), "error")
               .when(c("n_against") > 0, "flag").otherwise("pass"))
    j = j.withColumn("verdict", verdict).withColumn(
        "status", F.when(c("verdict") == "pass", "complete").otherwise("needs_review"))
    shown = first_rows(flags.where("hard"), key, [c("label"), c("flag_pos")], n_shown) \
        .groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "label", "code"))), "; ").alias("_first"))
    j = j.join(shown, key, "left")
    text = (F.when(c("n_hard") > 0, F.concat(F.lit("contradiction: "), c("_first"),
                                             F.when(c("n_hard") > n_shown, F.concat(F.lit("; +"), (c("n_hard") - n_shown).cast("string"), F.lit(" more"))).otherwise("")))
            .when(c("verdict") == "error", "second check unavailable").when(c("verdict") == "flag", "checker flagged")
            .otherwise(F.concat(F.lit("passed with "), c("n_soft").cast("string"), F.lit(" concern(s)"))))
    return j.select(*key, "n_rows", "n_hard", "n_soft", "verdict", "status", text.alias("summary"))


def advise(flags: DataFrame, spark) -> DataFrame:
    """The advised lean of each flagged item, from its first hard flag that has advice."""
    dim = lit_dim(spark, list(fixed.ADVICE_LEAN.items()), "code string, lean string")
    hard = flags.where("hard").join(dim, "code", "left")
    first = latest(hard, ["geoid", "category"], [c("lean").isNotNull(), -c("row_no"), -c("flag_pos")], ["code", "lean"])
    lean = F.coalesce("lean", F.lit("unsure"))
    return first.select("geoid", "category", F.when(c("lean").isNotNull(), c("code")).alias("code"), lean.alias("lean"),
                        choose(fixed.LEAN_STATUS, lean).alias("suggested_status"))
