"""Version-preserving merges and as-of rule resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import choose, text_year
from ..functions.shared import kept
from ..functions.scan import anti, coalescing_upsert, flag_in, insert_ignore, latest, semi

FACT_KEY = ["geoid", "category", "instrument_code"]


# -- D1 ---------------------------------------------------------------------

#: Nodes of the tree over an array of arrivals that have one parent; a text that follows every day of its year.
FAN_IN, YEAR_END = 64, "\U0010ffff"
LIVE = "struct<rank:string,seq:bigint>"


def _takes(step: Column, live: Column) -> Column:
    """Whether ``step`` displaces ``live``."""
    return live["rank"] <= step["upto"]


def _composed(first: Column, then: Column) -> Column:
    """One step that does what the two do in turn."""
    inner = lambda x: F.when(_takes(then, first), then[x]).otherwise(first[x]).alias(x)
    return F.when(then["upto"] >= first["upto"], then).otherwise(F.struct(inner("rank"), inner("seq"), first["upto"].alias("upto")))


def _others(rows: DataFrame, keys: list[str], seq: str, only: list[str] | None) -> list[str]:
    return [x for x in rows.columns if x not in (*keys, seq) and (only is None or x in only)]


def _steps(rows: DataFrame, keys: list[str], seq: str, bare_years: bool, only: list[str] | None = None) -> DataFrame:
    """Each arrival as a step: the row it makes live, and the greatest rank that it displaces.

    A rank is the day, or the year in the same order; a bare year ranks before its days, a row without
    a year before all. An undated arrival displaces everything, a bare year whatever
    lies in it or before, a date whatever is not later. ``only`` names the other columns that go along, all of them without it.
    """
    c, rest = F.col, _others(rows, keys, seq, only)
    day = F.when(text_year(c("effective_date")).isNotNull(), F.substring("effective_date", 1, 10))
    year = F.coalesce(text_year(day), c("fiscal_year").cast("int")) if bare_years else text_year(day)
    # years of four digits are as in days; '!' comes before digits, ':' behind them
    long = lambda x: F.lpad(x.cast("string"), 10, "0")
    at = F.when(year < 0, F.concat(F.lit("!"), long(year.cast("long") + (1 << 31)))).when(year > 9999, F.concat(F.lit(":"), long(year))) \
        .otherwise(F.lpad(year.cast("string"), 4, "0"))
    upto = F.when(at.isNull(), "~").otherwise(F.coalesce(day, F.concat(at, F.lit(YEAR_END))))
    rank = F.coalesce(day, at, F.lit(""))
    step = F.struct(rank.alias("rank"), c(seq).cast("long").alias("seq"), upto.alias("upto"))
    held = [F.struct(*rest).alias("_rest")] if rest else []
    return rows.select(*keys, c(seq).cast("long").alias("_seq"), step.alias("_step"), *held)


def _gathered(steps: DataFrame, keys: list[str], at: str, fan: int) -> DataFrame:
    """Nodes over at most ``fan`` places each: their steps in order, and these composed; ``_rest``, if any, in the same order."""
    held = [F.col(at).alias("at"), F.col("_step").alias("step"), *[F.col(x) for x in steps.columns if x == "_rest"]]
    nodes = steps.groupBy(*keys, F.floor(F.col(at) / fan).alias("_node")).agg(F.collect_list(F.struct(*held)).alias("_held"))
    # places are sorted with their index in the list, natively: a comparator in SQL is read for each pair, and other columns may have no order
    places = F.sort_array(F.transform("_held", lambda x, i: F.struct(x["at"].alias("at"), i.alias("i"))))
    nodes = nodes.withColumn("_at", places).withColumn("_held", F.transform("_at", lambda p: F.get("_held", p["i"]))).drop("_at")
    parts = {"_kids": F.transform("_held", lambda x: F.struct(x["at"].alias("at"), x["step"].alias("step")))}
    if "_rest" in steps.columns:
        parts["_rest"] = F.transform("_held", lambda x: x["_rest"])
    nodes = nodes.withColumns(parts).drop("_held")
    whole = F.aggregate(F.slice("_kids", 2, fan), F.col("_kids")[0]["step"], lambda done, kid: _composed(done, kid["step"]))
    return nodes.withColumn("_step", whole)


def _entered(nodes: DataFrame) -> Column:
    """Per kid of a node the live row that it meets; the node itself meets ``_live``."""
    start = F.struct(F.col("_live").alias("live"), F.expr(f"cast(array() as array<struct<at:bigint,takes:boolean,live:{LIVE}>>)").alias("out"))

    def enter(acc: Column, kid: Column) -> Column:
        takes, row = _takes(kid["step"], acc["live"]), F.struct(kid["step"]["rank"].alias("rank"), kid["step"]["seq"].alias("seq"))
        seen = F.struct(kid["at"].alias("at"), takes.alias("takes"), acc["live"].alias("live"))
        return F.struct(F.when(takes, row).otherwise(acc["live"]).alias("live"), F.concat(acc["out"], F.array(seen)).alias("out"))

    return F.aggregate("_kids", start, enter, lambda acc: acc["out"])


def _next_heads(heads: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(keys, _node, _after): the first ``_head`` among the later nodes of a key; up the tree by minima, down by siblings."""
    if not levels:
        return heads.select(*keys, "_node", F.lit(None).cast("long").alias("_after"))
    c = F.col
    held = heads.withColumn("_up", F.floor(c("_node") / FAN_IN))
    up = held.groupBy(*keys, "_up").agg(F.min("_head").alias("_head")).withColumnRenamed("_up", "_node")
    above = _next_heads(up, keys, levels - 1).withColumnRenamed("_node", "_up").withColumnRenamed("_after", "_beyond")
    later = Window.partitionBy(*keys, "_up").orderBy("_node").rowsBetween(1, Window.unboundedFollowing)
    near = held.withColumn("_near", F.first("_head", ignorenulls=True).over(later))
    return near.join(above, [*keys, "_up"]).select(*keys, "_node", F.coalesce("_near", "_beyond").alias("_after"))


def supersede(rows: DataFrame, keys: list[str] | None = None, seq: str = "arrival_seq",
              bare_years: bool = True, chunk_rows: int = 256, only: list[str] | None = None) -> DataFrame:
    """Which arrivals became the live row, and what displaced each row.

    ``rows`` holds the arrivals of every key, the stored live row (if any) being
    the first; ``seq`` counts them per key.  A row clearly older than the live one is
    filed as history and points at it; every other row becomes live and is later
    pointed at by the next one that does.  Two effective dates compare as dates; once a
    bare fiscal year is involved only years compare, and only a strictly lower year is
    older; a row without either is never older.

    The live row is a fold over arrivals.  An arrival maps the live row before it to
    the one after it: whatever ranks up to a bound gives way, anything above stays.
    Two such steps in turn are one again, so a key is a tree: ``chunk_rows`` arrivals
    are one step, ``FAN_IN`` steps are one, until one is left; on the way down each
    node learns the live row it meets.  A task sees one node and its kids, however many
    versions a key has.  Nodes over the arrivals, with their other columns, are stored
    once; keys of up to ``chunk_rows`` arrivals need no other level.
    ``only`` names the other columns to give back, all of them without it.
    ``bare_years=False`` is for sources without a fiscal year.  An effective date that
    does not start with a year counts as missing.  Rows with a null key are left out.
    """
    keys, c = keys or FACT_KEY, F.col
    rest = _others(rows, keys, seq, only)
    low = kept(_gathered(_steps(rows, keys, seq, bare_years, only), keys, "_seq", chunk_rows), "arrivals")
    least, most = low.agg(F.min("_node"), F.max("_node")).first()
    nodes, width = [low.withColumn("_node", c("_node") - (least or 0))], (most or 0) - (least or 0)
    while width:
        nodes.append(_gathered(nodes[-1].select(*keys, "_node", "_step"), keys, "_node", FAN_IN))
        width //= FAN_IN
    none = F.struct(F.lit("").alias("rank"), F.lit(None).cast("long").alias("seq"))   # no row is live yet
    met = nodes[-1].withColumn("_live", none)
    for below in reversed(nodes[:-1]):
        kids = met.select(*keys, F.explode(_entered(met)).alias("_kid")).select(*keys, c("_kid.at").alias("_node"), c("_kid.live").alias("_live"))
        met = below.join(kids, [*keys, "_node"])
    held = ["_rest"] if rest else []
    seen = met.select(*keys, "_node", *held, _entered(met).alias("_seen"))
    if len(nodes) > 1:
        # until one takes, all kids of a node meet the live row that the node meets: no fold tells the first
        first = F.array_min(F.transform(F.filter("_kids", lambda kid: _takes(kid["step"], c("_live"))), lambda kid: kid["at"]))
        seen = seen.join(_next_heads(met.select(*keys, "_node", first.alias("_head")), keys, len(nodes) - 1), [*keys, "_node"])
    else:
        seen = seen.withColumn("_after", F.lit(None).cast("long"))
    # from the last arrival back: the next one that became live
    start = F.struct(c("_after").alias("after"), F.expr("cast(array() as array<struct<at:bigint,takes:boolean,link:bigint>>)").alias("out"))

    def linked(acc: Column, r: Column) -> Column:
        link = F.struct(r["at"].alias("at"), r["takes"].alias("takes"), F.when(r["takes"], acc["after"]).otherwise(r["live"]["seq"]).alias("link"))
        return F.struct(F.when(r["takes"], r["at"]).otherwise(acc["after"]).alias("after"), F.concat(acc["out"], F.array(link)).alias("out"))

    links = F.aggregate(F.reverse("_seen"), start, linked, lambda acc: acc["out"])
    flat = seen.select(*keys, F.explode(F.arrays_zip(F.reverse(links).alias("link"), *[c(x).alias("rest") for x in held])).alias("_r"))
    number = c("_r.link.at").cast(rows.schema[seq].dataType).alias(seq)
    back = [x for x in dict.fromkeys([*keys, seq, *rows.columns]) if x in (*keys, seq, *rest)]
    return flat.select(*[number if x == seq else c(x) if x in keys else c(f"_r.rest.`{x}`").alias(x) for x in back],
                       c("_r.link.takes").alias("became_live"), c("_r.link.link").alias("superseded_by"))


# -- D2-D5 ------------------------------------------------------------------

THRESHOLD_KEY = ["state_usps", "jurisdiction_kind", "measure_class", "instrument_code",
                 "purpose_restriction", "effective_from"]
GRANT_KEY = ["state_usps", "jurisdiction_kind", "category", "instrument_code", "effective_from"]


def _value_cols(df, keys, seq):
    return [c for c in df.columns if c not in keys and c != seq]


def _upsert(existing, incoming, keys, seq):
    """Blank key parts equal null ones; state codes are upper-cased."""
    def tidy(df):
        for k in keys:
            df = df.withColumn(k, F.when(F.col(k) != "", F.upper(k) if k == "state_usps" else F.col(k)))
        return df
    return coalescing_upsert(tidy(existing), tidy(incoming), keys, _value_cols(existing, keys, seq), seq)


def upsert_thresholds(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Fill and correct threshold rules; a null never blanks a stored value."""
    return _upsert(existing, incoming, THRESHOLD_KEY, seq)


def upsert_grants(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """D3: the same for authority grants."""
    return _upsert(existing, incoming, GRANT_KEY, seq)


def upsert_measures(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """The same for measures, identified by the local id, or by title where there is none."""
    def keyed(df):
        return df.withColumn("_by", F.when(F.col("measure_id_local").isNotNull(), "id").otherwise("title")) \
            .withColumn("_ident", F.coalesce("measure_id_local", "official_title", F.lit("")))
    keys = ["geoid", "election_date", "_by", "_ident"]
    cols = [c for c in existing.columns if c not in keys and c != seq]
    return coalescing_upsert(keyed(existing), keyed(incoming), keys, cols, seq).drop("_by", "_ident")


def patch_profiles(existing: DataFrame, patches: DataFrame, seq: str = "seq") -> DataFrame:
    """Set the given fields of a state's profile, adding a stub where it has none.

    A patch without any value changes nothing, and the verifier is the last patch's.
    """
    fields = [c for c in existing.columns if c not in ("state_usps", seq, "state_name", "verified_by", "verified_at")]
    p = patches.withColumn("state_usps", F.upper("state_usps")) \
        .where(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull()) \
        .withColumn("state_name", F.lit(None).cast("string"))
    cols = [*fields, "state_name", "verified_by", "verified_at"]
    out = coalescing_upsert(existing, p, ["state_usps"], cols, seq)
    return out.withColumn("state_name", F.coalesce("state_name", "state_usps"))


# -- D6, D7 -----------------------------------------------------------------

def vote_arithmetic(m: DataFrame) -> DataFrame:
    """Total, yes share, turnout and margin, each only where it is missing."""
    c = F.col
    m = m.withColumn("votes_total", F.coalesce(c("votes_total"), c("votes_yes") + c("votes_no")))
    share = F.when(c("votes_total") > 0, F.round(100.0 * c("votes_yes") / c("votes_total"), 4))
    m = m.withColumn("pct_yes", F.coalesce(c("pct_yes"), share))
    turn = F.when(c("registered_voters") > 0, F.round(100.0 * c("ballots_cast") / c("registered_voters"), 4))
    m = m.withColumn("turnout_pct", F.coalesce(c("turnout_pct"), turn))
    return margin(m)


def margin(m: DataFrame) -> DataFrame:
    """The margin is only meaningful where the threshold is a share of votes cast."""
    c = F.col
    basis_ok = c("threshold_basis").isNull() | c("threshold_basis").isin(fixed.VOTES_CAST_BASES)
    gap = F.when(basis_ok, F.round(c("pct_yes") - c("threshold_required"), 4))
    return m.withColumn("margin_vs_threshold", F.coalesce(c("margin_vs_threshold"), gap))


RULE_SCOPE = ["state_usps", "measure_class", "jurisdiction_kind", "instrument_code", "purpose_restriction"]
#: Levels of day blocks: day numbers have 23 bits.
LEVELS = 23


def day_number(text: Column, missing: int) -> Column:
    """A date text as a whole number in text order; years and months alone sort before their days, anything else is ``missing``."""
    part = lambda i: F.coalesce(F.try_element_at(F.split(text, "-"), F.lit(i)), F.lit("0")).try_cast("long")
    shaped = text.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$")
    return F.coalesce(F.when(shaped, part(1) * 512 + part(2) * 32 + part(3)), F.lit(missing).cast("long"))


def day_blocks(first: Column, last: Column) -> Column:
    """The range of days as blocks (level, i) of 2^level days that start at i * 2^level: two a level at most."""
    block = "array<struct<level:int,i:bigint>>"
    none = F.array().cast(block)
    start = F.struct(first.alias("a"), last.alias("b"), none.alias("out"))

    def step(acc, level):
        live = acc["a"] <= acc["b"]
        left, right = live & (acc["a"] % 2 == 1), live & (acc["b"] % 2 == 0)
        one = lambda x: F.array(F.struct(level.alias("level"), x.alias("i"))).cast(block)
        # an empty range stays empty: halving it could make it look full again
        return F.struct(F.when(live, F.shiftright(acc["a"] + left.cast("long"), 1)).otherwise(F.lit(1).cast("long")).alias("a"),
                        F.when(live, F.shiftright(acc["b"] - right.cast("long"), 1)).otherwise(F.lit(0).cast("long")).alias("b"),
                        F.concat(acc["out"], F.when(left, one(acc["a"])).otherwise(none), F.when(right, one(acc["b"])).otherwise(none)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step)["out"]


def block_code(level: Column, i: Column) -> Column:
    """A block of days as one number."""
    return level * (1 << LEVELS + 1) + i


def rules_by_block(rules: DataFrame) -> DataFrame:
    """For each scope and block of days, the rule that covers the whole block and wins there: the latest start, then the highest id.

    ``level`` is the block's level, ``block`` its code.
    """
    c = F.col
    key = [F.coalesce(k, F.lit("")).alias(f"k{i}") for i, k in enumerate(RULE_SCOPE)]
    ks = [f"k{i}" for i in range(len(RULE_SCOPE))]
    r = rules.select(*key, day_number(c("effective_from"), 0).alias("start"), day_number(c("effective_to"), (1 << LEVELS) - 1).alias("end"),
                     "id", "threshold_value", "threshold_basis")
    r = latest(r, [*ks, "start", "end"], [c("id")], ["id", "threshold_value", "threshold_basis"])
    blocks = r.withColumn("_b", F.explode(day_blocks(c("start"), c("end"))))
    blocks = blocks.withColumns({"level": c("_b.level"), "block": block_code(c("_b.level"), c("_b.i"))})
    return latest(blocks, [*ks, "level", "block"], [c("start"), c("id")], ["start", "id", "threshold_value", "threshold_basis"])


def resolve_thresholds(measures: DataFrame, places: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule in force on each measure's election day, most specific first.

    Own kind beats statewide, own instrument beats general, own purpose beats
    'either' beats none.  A rule's days are written as few blocks of days, two a level
    at most; a day lies in one block a level.  So days meet rules by equality, never by
    range, whatever the number of rules in a scope.  A scope's levels are known as bits:
    questions first lose the scopes without rules, then each (scope, day) that is left is
    looked up once, on the levels in use.
    """
    c = F.col
    own = places.select("geoid", c("state_usps").alias("_s"), c("kind").alias("_kd"))
    asked = measures.join(own, "geoid", "left").select(
        "*", F.coalesce("instrument_code", F.lit("")).alias("_in"), F.coalesce("measure_class", F.lit("")).alias("_mc"),
        F.when(c("purpose_type").isin("general", "special"), c("purpose_type")).otherwise("").alias("_pu"),
        c("election_date").alias("_day"))
    q = ["_s", "_mc", "_kd", "_in", "_pu", "_day"]
    ks = [f"k{i}" for i in range(len(RULE_SCOPE))]
    none = F.lit("")
    asks = asked.where(c("_s").isNotNull() & c("_day").isNotNull()).select(*q).distinct()
    or_none = lambda x: F.when(c(x) != "", F.array(c(x), none)).otherwise(F.array(none))
    purposes = F.when(c("_pu") != "", F.array(c("_pu"), F.lit("either"), none)).otherwise(F.array(F.lit("either"), none))
    for name, choice in (("k2", or_none("_kd")), ("k3", or_none("_in")), ("k4", purposes)):
        asks = asks.withColumn(name, F.explode(choice))
    rank = (F.when(c("k2") != "", 100).otherwise(0) + F.when(c("k3") != "", 10).otherwise(0)
            + F.when(c("k4") == "either", 1).when(c("k4") != "", 2).otherwise(0))
    asks = asks.select(c("_s").alias("k0"), c("_mc").alias("k1"), "k2", "k3", "k4", rank.alias("rank"), *q)
    blocks = rules_by_block(rules)
    used = blocks.groupBy(*ks).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), c("level"))).alias("used"))
    asks = asks.withColumn("day", day_number(c("_day"), 0)).join(used, ks)
    levels = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda x: F.getbit(c("used"), x) == 1)
    code = lambda x: block_code(x.cast("long"), F.call_function("shiftright", c("day"), x))
    looked = asks.select(*ks, "day", "used").distinct().withColumn("block", F.explode(F.transform(levels, code)))
    found = latest(looked.join(blocks, [*ks, "block"]), [*ks, "day"], [c("start"), c("id")], ["start", "id", "threshold_value", "threshold_basis"])
    hits = asks.join(found, [*ks, "day"]).withColumn("held", F.struct("id", "threshold_value", "threshold_basis"))
    best = latest(hits, q, [c("rank"), c("start"), c("id")], ["held"])
    out = asked.join(best, q, "left")
    return out.select(*measures.columns, c("held.id").alias("rule_id"), c("held.threshold_value").alias("rule_value"),
                      c("held.threshold_basis").alias("rule_basis"))


def derive_measures(measures: DataFrame, places: DataFrame, rules: DataFrame) -> DataFrame:
    """D6 + D7: complete a measure row; a supplied threshold is kept as it is."""
    c = F.col
    m = resolve_thresholds(measures, places, rules)
    ask = c("threshold_required").isNull() & c("rule_id").isNotNull()
    m = m.withColumn("threshold_rule_id", F.when(ask, c("rule_id"))) \
        .withColumn("threshold_basis", F.when(ask, F.coalesce("threshold_basis", "rule_basis")).otherwise(c("threshold_basis"))) \
        .withColumn("threshold_required", F.coalesce("threshold_required", "rule_value")) \
        .drop("rule_id", "rule_value", "rule_basis")
    return vote_arithmetic(m)


# -- D8 ---------------------------------------------------------------------

CITE_KEY = ["claim_table", "claim_id", "source_id", "role"]


def cite_claims(existing: DataFrame, claims: DataFrame) -> DataFrame:
    """Provenance rows to append: the primary citation plus each corroborating one.

    ``claims`` has claim_table, claim_id, source_id, source_quote and
    ``corroborating`` array<struct<source_id, role, observed_value>>; source ids
    come from the source dimension (B11).
    """
    cite = lambda source, role, value: F.struct(source.alias("source_id"), role.alias("role"), value.alias("observed_value"))
    prim = F.array(cite(F.col("source_id"), F.lit("primary"), F.col("source_quote")))
    more = F.transform("corroborating", lambda x: cite(x["source_id"], F.coalesce(x["role"], F.lit("corroborating")), x["observed_value"]))
    every = F.when(F.col("corroborating").isNull(), prim).otherwise(F.concat(prim, more))   # one list, so that claims are read once
    rows = claims.select("claim_table", "claim_id", F.posexplode_outer(every).alias("_pos", "_c")) \
        .select("claim_table", "claim_id", "_c.*", "_pos").where(F.col("source_id").isNotNull()) \
        .withColumn("agrees", F.col("role").isin("primary", "corroborating").cast("int"))
    return insert_ignore(existing, rows, CITE_KEY, [F.col("_pos")]).drop("_pos")


# -- D9, D10 ----------------------------------------------------------------

def bulk_answered(facts: DataFrame) -> DataFrame:
    """Keys an adapter answers with a live row."""
    return facts.where(F.col("superseded_by").isNull() & (F.col("extraction_method") == "bulk_import")) \
        .select("geoid", "category").distinct()


def touch_items(written: DataFrame, places: DataFrame, facts: DataFrame) -> DataFrame:
    """Items to open or move for written keys: complete where a bulk row answers, else review."""
    keys = semi(written.select("geoid", "category").distinct(), places, ["geoid"])
    marked = flag_in(keys, bulk_answered(facts), ["geoid", "category"], "from_bulk")
    return marked.select("geoid", "category", F.when(F.col("from_bulk"), "complete").otherwise("needs_review").alias("status"),
                         F.when(F.col("from_bulk"), fixed.BULK_NOTE).alias("last_error"))


def measure_items(measures: DataFrame, places: DataFrame, work: DataFrame) -> DataFrame:
    """Measured places that may hold an elections item: counties, or an item already there."""
    m = measures.select("geoid").distinct().join(places.select("geoid", "kind"), "geoid", "left")
    held = work.where(F.col("category") == fixed.COUNTY_PASS)
    m = flag_in(m, held, ["geoid"], "held")
    return m.where(F.col("held") | (F.col("kind") == fixed.PASS_KIND[fixed.COUNTY_PASS])) \
        .select("geoid", F.lit(fixed.COUNTY_PASS).alias("category"))


# -- D11-D14 ----------------------------------------------------------------

COVER_KEY = ["domain", "scope_type", "scope_geoid"]
COVER_DETAIL = ["jurisdiction_kind", "period_start", "period_end"]


def assert_coverage(existing: DataFrame, claims: DataFrame, only_if_absent: bool = False) -> DataFrame:
    """Coverage after claims: replace a scope's assertion, or leave held scopes alone.

    Both frames share columns; ``asserted_seq`` orders claims of one scope.
    """
    if only_if_absent:
        return existing.unionByName(insert_ignore(existing, claims, COVER_KEY, [F.col("asserted_seq")]))
    full = COVER_KEY + [x for x in COVER_DETAIL if x in existing.columns]
    newest = latest(claims, full, [F.col("asserted_seq")])
    return anti(existing, newest, full, nullsafe=True).unionByName(newest.select(*existing.columns))


def partial_coverage(measures: DataFrame, places: DataFrame) -> DataFrame:
    """A cautious 'partial' claim per measured place, with the number found."""
    n = measures.groupBy("geoid").agg(F.count("*").alias("measures_found"))
    kinds = n.join(places.select("geoid", "kind"), "geoid", "left")
    scope = F.coalesce(choose(fixed.SCOPE_TYPE_BY_KIND, F.col("kind")), F.lit("place"))
    return kinds.select(F.lit("ballot_measure").alias("domain"), scope.alias("scope_type"),
                        F.col("geoid").alias("scope_geoid"), F.lit("partial").alias("completeness"), "measures_found")


def state_stubs(existing: DataFrame, states: DataFrame, domain: str = "ballot_measure") -> DataFrame:
    """A 'none' assertion for every state that has no assertion of its own."""
    stub = states.select(F.lit(domain).alias("domain"), F.lit("state").alias("scope_type"),
                         F.col("fips").alias("scope_geoid"), F.lit("none").alias("completeness"))
    return anti(stub, existing, COVER_KEY)


def settle_empty(outcomes: DataFrame) -> DataFrame:
    """Items whose read wrote nothing.

    An elections read without rejects means searched-and-empty: no_data with a
    spot-checked coverage claim of zero found; anything else goes to review.
    """
    empty = outcomes.where(F.col("written") == 0)
    searched = (F.col("category") == fixed.COUNTY_PASS) & (F.col("rejected") == 0)
    return empty.select("geoid", "category", F.when(searched, "no_data").otherwise("needs_review").alias("status"),
                        F.when(searched, "spot_checked").alias("completeness"),
                        F.when(searched, F.lit(0).cast("long")).alias("measures_found"))


# -- D15 --------------------------------------------------------------------

def revenue_bases(records: DataFrame, places: DataFrame, vintage: str) -> DataFrame:
    """Tax collections per place and year in dollars; the last record of a key wins."""
    base = choose({k: v[0] for k, v in fixed.FINANCE_ITEMS.items()}, F.col("item"))
    rows = semi(records.withColumn("base_type", base).where(F.col("base_type").isNotNull()), places, ["geoid"])
    last = latest(rows, ["geoid", "fiscal_year", "base_type"], [F.col("line_no")], ["amount_thousands"])
    return last.select("geoid", "fiscal_year", "base_type",
                       (F.coalesce("amount_thousands", F.lit(0)) * 1000).alias("base_value"),
                       F.lit("usd").alias("base_unit"), F.lit(vintage).alias("vintage"))


def replace_vintage(existing: DataFrame, fresh: DataFrame, vintage: str) -> DataFrame:
    """The stored bases with one vintage swapped for a fresh load."""
    return existing.where(F.col("vintage") != vintage).unionByName(fresh.select(*existing.columns))
