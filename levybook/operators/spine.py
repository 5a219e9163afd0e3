"""Place registry and key resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import alnum, lit_dim, place_key, url_host
from ..functions.scan import anti, insert_ignore


def state_dim(spark) -> DataFrame:
    return lit_dim(spark, fixed.STATES, "fips string, usps string, state_name string")


def crosswalk(spark) -> DataFrame:
    """Census state sequence <-> FIPS, 51 fixed rows."""
    return lit_dim(spark, fixed.CENSUS_STATES, "fips_state string, census_state string, usps string, name string")


def census_to_fips(df: DataFrame, spark, code: str) -> DataFrame:
    """Adds fips_state; unknown codes get null."""
    padded = F.lpad(F.col(code).try_cast("int").cast("string"), 2, "0")
    return df.withColumn("census_state", padded) \
        .join(crosswalk(spark).select("census_state", "fips_state"), "census_state", "left").drop("census_state")


def geoid_state(df: DataFrame, spark, geoid: str = "geoid") -> DataFrame:
    """Adds the postal code of a geoid's first two digits."""
    d = state_dim(spark).select(F.col("fips").alias("_f"), F.col("usps").alias("geoid_usps"))
    return df.join(d, F.substring(geoid, 1, 2) == F.col("_f"), "left").drop("_f")


def build_places(gaz: DataFrame, populations: DataFrame) -> DataFrame:
    """B1: registry rows from gazetteer rows (kind, geoid, usps, name, funcstat).

    Inactive places and townships are left out; a Virginia "city" filed as a
    county is its own county.
    """
    c = F.col
    stat = F.coalesce(F.when(c("funcstat") != "", c("funcstat")), F.when(c("kind") == "county", "A"))
    rows = gaz.withColumn("funcstat", stat) \
        .where((c("kind") == "county") | F.coalesce(c("funcstat") == "A", F.lit(False)))
    st, cty = F.substring("geoid", 1, 2), F.substring("geoid", 1, 5)
    return rows.join(populations, "geoid", "left").select(
        "geoid", "kind", "name", c("usps").alias("state_usps"), st.alias("state_fips"),
        F.when(c("kind") == "county", c("geoid")).when(c("kind") == "mcd", cty).alias("county_fips"),
        F.when(c("kind") == "mcd", cty).otherwise(st).alias("parent_geoid"), "funcstat", "population",
        ((c("kind") == "county") & (c("usps") == "VA") & F.lower("name").contains("city")).cast("int").alias("coterminous"))


def upsert_places(existing: DataFrame, fresh: DataFrame, hand_written: list[str]) -> DataFrame:
    """B2: the fresh registry replaces what it owns; hand-written columns stay."""
    owned = [c for c in fresh.columns if c != "geoid"]
    e = existing.select("geoid", *[F.col(c).alias(f"e_{c}") for c in [*owned, *hand_written]], F.lit(True).alias("_held"))
    f = fresh.withColumn("_new", F.lit(True))
    j = e.join(f, "geoid", "full")
    return j.select("geoid", *[F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"e_{c}")).alias(c) for c in owned],
                    *[F.col(f"e_{c}").alias(c) for c in hand_written])


def profile_stubs(existing: DataFrame, states: DataFrame) -> DataFrame:
    """A profile row for each state without one."""
    stub = states.select(F.col("usps").alias("state_usps"), "state_name")
    return anti(stub, existing, ["state_usps"])


def state_rows(states: DataFrame, populations: DataFrame) -> DataFrame:
    """Registry rows of the states themselves."""
    p = populations.select(F.col("geoid").alias("fips"), "population")
    return states.join(p, "fips", "left").select(
        F.col("fips").alias("geoid"), F.lit("state").alias("kind"), F.col("state_name").alias("name"),
        F.col("usps").alias("state_usps"), F.col("fips").alias("state_fips"), F.lit("A").alias("funcstat"), "population")


def finance_geoid(records: DataFrame, directory: DataFrame, places: DataFrame, spark) -> DataFrame:
    """Finance records to geoids.

    The unit id starts with the census state sequence, not FIPS.  States map
    directly, counties by (state, letters-and-digits name) with the later county
    winning a repeated name, cities by the directory's five-digit place code
    unless it starts with 99.
    """
    c = F.col
    r = census_to_fips(records, spark, "id_state")
    r = r.join(directory.select("unit_id", c("name").alias("unit_name"), "place_code"), "unit_id", "left") \
        .withColumn("_key", alnum(c("unit_name")))
    county = places.where(c("kind") == "county").select("geoid", F.substring("geoid", 1, 2).alias("fips_state"),
                                                        alnum(c("name")).alias("_key"))
    county = county.groupBy("fips_state", "_key").agg(F.max("geoid").alias("county_geoid"))
    r = r.join(county, ["fips_state", "_key"], "left")
    code_ok = (F.length("place_code") == 5) & ~c("place_code").startswith("99")
    geoid = (F.when(c("unit_type") == "0", c("fips_state"))
             .when(c("unit_type") == "1", c("county_geoid"))
             .when((c("unit_type") == "2") & code_ok, F.concat("fips_state", "place_code")))
    return r.withColumn("geoid", geoid).drop("_key", "county_geoid", "unit_name", "place_code")


def resolve_names(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(state, kind, name) -> geoid; 'unknown' or 'ambiguous:n' where it is not unique."""
    look = places.select("state_usps", "kind", place_key(F.col("name")).alias("name_key"), "geoid") \
        .groupBy("state_usps", "kind", "name_key").agg(F.count("*").alias("n"), F.min("geoid").alias("hit"))
    a = asked.withColumn("name_key", place_key(F.col("name"))).join(look, ["state_usps", "kind", "name_key"], "left")
    n = F.col("n")
    return a.withColumn("geoid", F.when(n == 1, F.col("hit"))) \
        .withColumn("reason", F.when(n.isNull(), F.lit("unknown")).when(n > 1, F.concat(F.lit("ambiguous:"), n.cast("string")))) \
        .drop("n", "hit")


def find_places(places: DataFrame, text: str, limit: int = 30) -> DataFrame:
    """By part of the name, exact geoid or exact state, most populous first."""
    like = "%" + text.replace("\\", "\\\\") + "%"
    hit = F.col("name").ilike(like) | (F.col("geoid") == text) | (F.col("state_usps") == text.upper())
    return places.where(hit).select("geoid", "name", "state_usps", "kind", "population") \
        .orderBy(F.col("population").desc_nulls_last(), "geoid").limit(limit)


def source_changes(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fold fetch results (http_status, body_sha) into sources.

    An empty body keeps the stored hash; refusals that prove a page exists count as resolving.
    """
    c = F.col
    j = sources.join(fetched.select("source_id", "http_status", "body_sha"), sources["id"] == fetched["source_id"])
    ok = c("http_status").between(200, 399) | c("http_status").isin(401, 403, 405)
    sha = F.when(c("http_status").between(200, 399), c("body_sha"))
    return j.select("id", "url", "http_status", F.coalesce(ok, F.lit(False)).cast("int").alias("verified"),
                    F.coalesce(sha, c("content_sha256")).alias("content_sha256"),
                    F.coalesce(c("content_sha256") != sha, F.lit(False)).cast("int").alias("content_changed"))


def merge_sources(existing: DataFrame, asked: DataFrame) -> DataFrame:
    """One row per (url, scope); the first writer fixes it, later tags refresh ``categories``."""
    key = ["url", "scope_geoid"]
    cols = [c for c in existing.columns if c not in key and c != "seq"]
    both = existing.select(*key, *cols, "seq").unionByName(asked.select(*key, *cols, "seq"))
    tag = F.max_by("categories", F.when(F.coalesce("categories", F.lit("")) != "", F.col("seq")))
    aggs = [F.min_by(F.struct(*[c for c in cols if c != "categories"]), F.col("seq")).alias("_first"), tag.alias("categories")]
    g = both.groupBy(*key).agg(*aggs)
    return g.select(*key, *[F.col("_first")[c].alias(c) for c in cols if c != "categories"], "categories")


def adopt_sources(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Give an unscoped source its catalog scope, unless the scoped one exists."""
    c = F.col
    loose = sources.where(c("scope_geoid").isNull()).join(
        catalog.select("url", c("scope_geoid").alias("_scope")), "url", "left")
    have = sources.select("url", c("scope_geoid").alias("_scope")).where(c("_scope").isNotNull()).distinct() \
        .withColumn("_dup", F.lit(True))
    loose = loose.join(have, ["url", "_scope"], "left")
    scope = F.when(c("_dup").isNull(), c("_scope"))
    cols = sources.columns
    fixed_up = loose.withColumn("scope_geoid", scope).select(*cols)
    return sources.where(c("scope_geoid").isNotNull()).unionByName(fixed_up)


def source_tier(url: Column, source_type: Column) -> Column:
    """Primary law 1, government 2, other institutions 3, anything else 4."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = url_host(url)
    return (F.when(source_type.isin("statute", "ordinance"), 1)
            .when(source_type == "secondary", 3)
            .when(host.rlike(fixed.STATUTE_HOST_PATTERN) | low.rlike(fixed.STATUTE_PATH_PATTERN), 1)
            .when(host.endswith(".gov") | host.endswith(".us") | host.contains(".gov."), 2)
            .when(host.endswith(".org") | host.endswith(".edu"), 3).otherwise(4))


def new_documents(existing: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Document registry entries to append: first arrival per (hash, url)."""
    return insert_ignore(existing, arrivals, ["sha256", "url"], [F.col("arrival_seq")])
