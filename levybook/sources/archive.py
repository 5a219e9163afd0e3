"""Archive, listings and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import anti
from ..operators.coverage import coverage_pivot
from ..operators.views import headroom, live

c = F.col
BASE_KEY = ["adapter", "url", "period_label"]


def archive_arrivals(spark: SparkSession, path: str, adapter: str, period_label: str) -> DataFrame:
    """A10: files as arrivals; the content hash is computed where the bytes are."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.lit(adapter).alias("adapter"), c("path").alias("url"), F.lit(period_label).alias("period_label"),
                    F.sha2("content", 256).alias("sha"), c("length").alias("byte_size"),
                    F.struct("modificationTime", "path").alias("arrival_seq"))


def archive_rows(arrivals: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A10: rows to add.  The first bytes of a key keep its label, other bytes go under 'period@sha12'.

    Both steps are aggregates (first hash per key, first arrival per hash).
    """
    first = arrivals.groupBy(*BASE_KEY).agg(F.min_by("sha", "arrival_seq").alias("first_sha"))
    if existing is not None:
        held = existing.select(*BASE_KEY, c("sha").alias("held_sha"))
        first = first.join(held, BASE_KEY, "left").withColumn("first_sha", F.coalesce("held_sha", "first_sha")).drop("held_sha")
    per_hash = arrivals.groupBy(*BASE_KEY, "sha").agg(F.min("arrival_seq").alias("arrival_seq"))
    out = per_hash.join(first, BASE_KEY).withColumn(
        "label", F.when(c("sha") == c("first_sha"), c("period_label")).otherwise(
            F.concat("period_label", F.lit("@"), F.substring("sha", 1, 12)))).drop("first_sha")
    if existing is not None:
        out = anti(out, existing.select("adapter", "url", c("period_label").alias("label")), ["adapter", "url", "label"])
    return out


def list_archive(rows: DataFrame, adapter: str | None = None) -> DataFrame:
    """A11."""
    r = rows.where(c("adapter") == adapter) if adapter else rows
    return r.orderBy("adapter", "label", "arrival_seq")


def list_sources(sources: DataFrame, scope: str | None = None) -> DataFrame:
    """Sources of a scope, best authority first."""
    s = sources.where(c("scope_geoid") == scope) if scope else sources
    return s.orderBy("authority_tier", "name")


TAX_COLUMNS = ["state_usps", "kind", "geoid", "jurisdiction", "population", "category", "instrument_code", "status",
               "rate_value", "rate_unit", "cap_value", "cap_unit", "effective_date", "expiration_date", "source_name",
               "source_url", "authority_tier", "confidence", "extraction_method", "retrieved_at"]


def tax_export(facts: DataFrame, places: DataFrame, sources: DataFrame) -> DataFrame:
    """Live facts with place and source."""
    p = places.select("geoid", c("name").alias("jurisdiction"), "kind", "state_usps", "population")
    s = sources.select(c("id").alias("source_id"), c("name").alias("source_name"), c("url").alias("source_url"), "authority_tier")
    return live(facts).join(p, "geoid").join(s, "source_id").select(*TAX_COLUMNS)


def exports(t, states: list[str] | None = None, as_of: str | None = None) -> dict[str, DataFrame]:
    """The ten flat exports; some follow an optional state filter."""
    def of(df):
        return df.where(c("state_usps").isin([s.upper() for s in states])) if states else df
    names = t.jurisdiction.select("geoid", c("name").alias("jurisdiction"), "state_usps")
    return {
        "taxes": of(tax_export(t.facts, t.jurisdiction, t.source)),
        "coverage": coverage_pivot(t.work_item, t.jurisdiction),
        "jurisdictions": of(t.jurisdiction),
        "sources": t.source,
        "state_profiles": t.state_profile,
        "coverage_assertions": t.coverage_assertion,
        "thresholds": of(t.thresholds),
        "authority_caps": of(t.grants),
        "headroom": of(headroom(t.jurisdiction, t.grants, t.facts, as_of or t.as_of)),
        "ballot_measures": of(live(t.measures).join(names, "geoid")),
    }


def write_exports(frames: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per export, written in parallel and unsorted."""
    for name, df in frames.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def ask(spark: SparkSession, tables: dict[str, DataFrame], sql: str, limit: int | None = None, as_json: bool = False) -> DataFrame:
    """A read-only query over the tables, named ``{table}`` in it; optionally its first rows, or one JSON text per row.

    The query becomes a subquery, which only a query can be, so a statement that
    changes anything is refused when it is parsed; no view stays in the session.
    """
    out = spark.sql(f"SELECT * FROM (\n{sql}\n) AS asked", **tables)
    out = out if limit is None else out.limit(limit)
    return out.select(F.to_json(F.struct("*")).alias("json")) if as_json else out
