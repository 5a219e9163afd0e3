"""Row validation (C1-C10): rules are (code, predicate) pairs over one row.

``check`` turns a rule list into an ``errors`` array in one projection; a row is
valid when the array is empty.  A predicate that evaluates to null does not fire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.expr import any_of, iso_shaped
from ..functions.scan import flag_in

Rule = tuple[str, Column]
c = F.col


def check(df: DataFrame, rules: list[Rule], label: str, pos: str = "pos") -> DataFrame:
    """Adds ``errors``: 'label[pos]: code' for each rule that fires."""
    where = F.concat(F.lit(label + "["), F.coalesce(c(pos).cast("string"), F.lit("?")), F.lit("]: "))
    hits = F.array(*[F.when(F.coalesce(p, F.lit(False)), F.concat(where, F.lit(code))) for code, p in rules])
    return df.withColumn("errors", F.filter(hits, lambda e: e.isNotNull()))


def _missing(name): return F.coalesce(c(name).cast("string"), F.lit("")) == ""
def _outside(name, allowed): return c(name).isNull() | ~c(name).isin(allowed)
def _bad_if_given(name, allowed): return c(name).isNotNull() & ~c(name).isin(allowed)
def _off_range(name, lo, hi): return (c(name) < lo) | (c(name) > hi)
def _bad_date(name): return ~_missing(name) & ~iso_shaped(c(name))


def _source_rules() -> list[Rule]:
    return [("no_source_url", _missing("source_url")),
            ("bad_authority_tier", _bad_if_given("authority_tier", [1, 2, 3, 4]))]


def _pair_rules() -> list[Rule]:
    """Category, instrument, and whether they belong together."""
    fits = any_of((c("category") == k) & c("instrument_code").isin(v) for k, v in fixed.INSTRUMENTS_BY_CATEGORY.items())
    known = F.coalesce(c("instrument_code").isin(fixed.INSTRUMENTS), F.lit(False))
    return [("unknown_category", _outside("category", fixed.TAX_CATEGORIES)),
            ("unknown_instrument", ~known),
            ("instrument_not_in_category", known & c("category").isin(fixed.TAX_CATEGORIES) & ~fits)]


def finding_rules() -> list[Rule]:
    """C1."""
    return _pair_rules() + [
        ("unknown_status", _outside("status", fixed.STATUSES)),
        ("missing_geoid", _missing("geoid")),
        ("unknown_rate_unit", _bad_if_given("rate_unit", fixed.RATE_UNITS)),
        ("unknown_cap_type", _bad_if_given("cap_type", fixed.CAP_TYPES)),
        ("unknown_confidence", _outside("confidence", fixed.CONFIDENCE)),
        ("bad_voter_approval", _bad_if_given("voter_approval_required", fixed.TERNARY)),
        *_source_rules(),
        ("rate_without_unit", c("rate_value").isNotNull() & _missing("rate_unit")),
        ("percent_out_of_range", (c("rate_unit") == "percent") & _off_range("rate_value", 0, 25)),
        ("levied_without_rate", (c("status") == "levied") & c("rate_value").isNull()
         & ~F.coalesce(c("instrument_code").isin(fixed.RATELESS_INSTRUMENTS), F.lit(False))),
        ("expiration_not_iso", _bad_date("expiration_date")),
    ]


def measure_rules() -> list[Rule]:
    """Vote arithmetic included; run it on rows completed by ``derive_measures``."""
    yes, no, total = c("votes_yes"), c("votes_no"), c("votes_total")
    counted = F.coalesce(total, yes + no)
    implied = F.when(counted > 0, 100.0 * yes / counted)
    return [
        ("missing_geoid", _missing("geoid")),
        ("missing_election_date", _missing("election_date")),
        ("election_date_not_iso", _bad_date("election_date")),
        ("unknown_measure_class", _outside("measure_class", fixed.MEASURE_CLASSES)),
        ("unknown_outcome", _outside("outcome", fixed.OUTCOMES)),
        ("unknown_election_type", _bad_if_given("election_type", fixed.ELECTION_TYPES)),
        ("unknown_category", _bad_if_given("category", fixed.TAX_CATEGORIES)),
        ("unknown_instrument", _bad_if_given("instrument_code", fixed.INSTRUMENTS)),
        ("unknown_threshold_basis", _bad_if_given("threshold_basis", fixed.THRESHOLD_BASES)),
        ("unknown_confidence", _outside("confidence", fixed.CONFIDENCE)),
        *[(f"{f}_not_a_percentage", _off_range(f, 0, 100)) for f in ("pct_yes", "threshold_required", "turnout_pct")],
        *[(f"{f}_negative", c(f) < 0) for f in ("votes_yes", "votes_no", "votes_total", "registered_voters", "ballots_cast")],
        ("votes_exceed_total", yes + no > total),
        ("pct_yes_disagrees_with_votes", F.abs(implied - c("pct_yes")) > 0.5),
        ("passed_below_threshold", (c("outcome") == "passed") & (F.coalesce(c("pct_yes"), implied) < c("threshold_required"))),
        ("sunset_date_not_iso", _bad_date("sunset_date")),
        *_source_rules(),
    ]


def _state_rule() -> Rule:
    return ("bad_state_code", c("state_usps").isNull() | (F.length(F.trim("state_usps")) != 2))


def threshold_rules() -> list[Rule]:
    """Thresholds are percentages; 0.6667 for two thirds is refused."""
    tv = c("threshold_value")
    return [
        _state_rule(),
        ("unknown_kind", _bad_if_given("jurisdiction_kind", fixed.KINDS)),
        ("unknown_measure_class", _outside("measure_class", fixed.MEASURE_CLASSES)),
        ("unknown_instrument", _bad_if_given("instrument_code", fixed.INSTRUMENTS)),
        ("unknown_purpose", _bad_if_given("purpose_restriction", fixed.PURPOSES)),
        ("missing_threshold_value", tv.isNull()),
        ("threshold_not_a_percentage", _off_range("threshold_value", 0, 100)),
        ("threshold_is_a_fraction", (tv >= 0) & (tv <= 1.0)),
        ("unknown_threshold_basis", _outside("threshold_basis", fixed.THRESHOLD_BASES)),
        *[(f"bad_{f}", _bad_if_given(f, fixed.TERNARY))
          for f in ("sunset_required", "reimposition_allowed", "petition_alternative")],
        ("sunset_max_years_negative", c("sunset_max_years") < 0),
        ("cooling_off_months_negative", c("cooling_off_months") < 0),
        ("missing_cite", _missing("statute_cite")),
        ("unknown_confidence", _outside("confidence", fixed.CONFIDENCE)),
        ("effective_from_not_iso", _bad_date("effective_from")),
        ("effective_to_not_iso", _bad_date("effective_to")),
        *_source_rules(),
    ]


def grant_rules() -> list[Rule]:
    """C4."""
    return [
        _state_rule(),
        ("unknown_kind", _bad_if_given("jurisdiction_kind", fixed.KINDS)),
        *_pair_rules(),
        ("bad_permitted", _outside("permitted", fixed.PERMITTED)),
        ("rate_without_unit", c("max_rate").isNotNull() & _missing("max_rate_unit")),
        ("unknown_rate_unit", _bad_if_given("max_rate_unit", fixed.RATE_UNITS)),
        ("percent_out_of_range", (c("max_rate_unit") == "percent") & _off_range("max_rate", 0, 25)),
        ("barred_with_rate", (c("permitted") == "no") & c("max_rate").isNotNull()),
        ("missing_cite", _missing("statute_cite")),
        ("unknown_confidence", _outside("confidence", fixed.CONFIDENCE)),
        ("effective_from_not_iso", _bad_date("effective_from")),
        ("effective_to_not_iso", _bad_date("effective_to")),
        *_source_rules(),
    ]


def check_profiles(df: DataFrame, pos: str = "pos") -> DataFrame:
    """``profile`` is map<string,string> so that unknown fields stay visible."""
    p = c("profile")
    allowed = [*fixed.PROFILE_VOCAB, *fixed.PROFILE_FREE_FIELDS, "state_usps"]
    mx = p["local_sales_tax_max"]
    unknown = F.array_sort(F.filter(F.map_keys(p), lambda k: ~k.isin(allowed)))
    rules = [("bad_state_code", p["state_usps"].isNull() | (F.length(F.trim(p["state_usps"])) != 2)),
             *[(f"bad_{f}", p[f].isNotNull() & ~p[f].isin(v)) for f, v in fixed.PROFILE_VOCAB.items()],
             ("local_sales_tax_max_out_of_range", mx.isNotNull() & ~F.coalesce(mx.try_cast("double").between(0, 25), F.lit(False)))]
    out = check(df, rules, "profile", pos)
    extra = F.when(F.size(unknown) > 0, F.array(F.concat(F.lit("profile["), c(pos).cast("string"), F.lit("]: unknown_fields "),
                                                       F.array_join(unknown, ",")))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("errors", F.concat("errors", extra))


def iso_date_flag(df: DataFrame, column: str, out: str = "iso_shaped") -> DataFrame:
    """C6."""
    return df.withColumn(out, iso_shaped(c(column)))


def context_errors(df: DataFrame, places: DataFrame, label: str, pos: str = "pos") -> DataFrame:
    """Appends to ``errors`` what needs the registry: a real geoid, a known source type."""
    d = flag_in(df, places, ["geoid"], "_known") if "geoid" in df.columns else df.withColumn("_known", F.lit(True))
    gone = ~c("_known") & ~_missing("geoid") if "geoid" in df.columns else F.lit(False)
    prior = d.withColumnRenamed("errors", "_prior") if "errors" in d.columns else d.withColumn("_prior", F.array().cast("array<string>"))
    more = check(prior, [("geoid_not_seeded", gone), ("unknown_source_type", ~_missing("source_type")
                                                     & ~c("source_type").isin(fixed.SOURCE_TYPES))], label, pos)
    return more.withColumn("errors", F.concat("_prior", "errors")).drop("_prior", "_known")


def load_report(sections: dict[str, DataFrame], dry_run: bool = False, strict: bool = False) -> DataFrame:
    """Per section valid rows, errors and rows to write.

    In strict mode one error anywhere writes nothing; a dry run never writes.
    """
    parts = None
    for name, df in sections.items():
        one = df.select(F.lit(name).alias("section"), F.size("errors").alias("n_err"))
        parts = one if parts is None else parts.unionByName(one)
    g = parts.groupBy("section").agg(F.count_if(c("n_err") == 0).alias("valid"), F.sum("n_err").alias("rejected"))
    if dry_run:
        return g.withColumn("written", F.lit(0).cast("long"))
    if not strict:
        return g.withColumn("written", c("valid"))
    anywhere = F.sum("rejected").over(Window.partitionBy())  # over at most five section rows
    return g.withColumn("written", F.when(anywhere > 0, 0).otherwise(c("valid")))


def stamp(rows: DataFrame, section: str, geoid: Column | None = None, category: Column | None = None,
          state_usps: Column | None = None, researcher: Column | None = None,
          method: Column | None = None, source_url: Column | None = None) -> DataFrame:
    """Default values for fields a row leaves out; a given value is never replaced.

    A pass name is not a tax category and is never stamped on a finding.
    """
    fill: dict[str, Column] = {"extraction_method": method if method is not None else F.lit("agent_research")}
    if researcher is not None:
        fill["researcher"] = researcher
    if source_url is not None:
        fill["source_url"] = source_url
    if section in ("findings", "measures") and geoid is not None:
        fill["geoid"] = geoid
    if section == "findings" and category is not None:
        fill["category"] = F.when(category.isin(fixed.TAX_CATEGORIES), category)
    if section in ("thresholds", "grants", "profile") and state_usps is not None:
        fill["state_usps"] = state_usps
    for name, value in fill.items():
        rows = rows.withColumn(name, F.coalesce(c(name), value) if name in rows.columns else value)
    return rows


SECTIONS = ["findings", "measures", "thresholds", "grants", "profile"]


def parse_responses(df: DataFrame, schema: T.StructType | str, raw: str = "raw_response") -> DataFrame:
    """Model answers to documents: adds ``doc`` and ``error``.

    Monologue blocks are dropped (an open one means the answer was cut off); a
    fenced block wins, else the text from the first to the last brace.
    """
    text = F.trim(F.regexp_replace(c(raw), r"(?s)<think>.*?</think>", ""))
    cut = text.contains("<think>")
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).when(braces != "", braces).otherwise(text)
    keys = F.json_object_keys(body)
    kinds = F.from_json(body, "map<string,string>")
    any_section = any_of(F.coalesce(kinds[s], F.lit("")) != "" for s in SECTIONS)
    not_array = any_of(F.coalesce(kinds[s], F.lit("")).rlike(r"^\s*[^\[\s]") for s in SECTIONS if s != "profile")
    err = (F.when(c(raw).isNull(), "empty_response").when(cut, "unterminated_think")
           .when(keys.isNull() | kinds.isNull(), "not_json").when(~any_section, "no_section")
           .when(not_array, "section_not_an_array"))
    return df.withColumn("error", err).withColumn("doc", F.when(err.isNull(), F.from_json(body, schema)))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that passed (without the errors column) and rows that did not."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)
