"""Usage metering: allowance used per site, the usage ledger and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The free plan's starting allowance.
FREE_TIER = "free_tier"
FREE_ALLOWANCE = 10000


def meter(checked: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Requests that used allowance, per site (one ledger row per site and batch)."""
    out = (
        checked.filter(F.col("uses_allowance"))
        .groupBy(F.col("site").alias("site_id"))
        .agg(F.count(F.lit(1)).alias("used"))
    )
    if batch_id is not None:
        out = out.select(F.lit(batch_id).cast("bigint").alias("batch_id"), "site_id", "used")
    return out


def apply_usage(sites: DataFrame, usage: DataFrame) -> DataFrame:
    """New allowance = old - used, only where the site exists and old >= used
    (otherwise the decrement is refused and the allowance stays)."""
    u = usage.groupBy("site_id").agg(F.sum("used").cast("bigint").alias("_used"))
    j = sites.join(u, "site_id", "left")
    allow = F.col("request_allowance")
    new = F.when(F.col("_used").isNotNull() & (allow >= F.col("_used")), allow - F.col("_used")).otherwise(allow)
    return j.withColumn("request_allowance", new).drop("_used").select(*sites.columns)


def usage_summary(sites: DataFrame, prefs: DataFrame | None = None, metered: bool = True) -> DataFrame:
    """Per site: initial allowance (10000 on the free plan, else 0), used
    (never negative), remaining, and ``locked`` (metered, nothing left and
    the owner's payment not active)."""
    initial = F.when(F.col("plan") == FREE_TIER, F.lit(FREE_ALLOWANCE)).otherwise(F.lit(0)).cast("bigint")
    remaining = F.coalesce(F.col("request_allowance"), F.lit(0)).cast("bigint")
    out = sites.select(
        "site_id", "owner_sub", "plan",
        initial.alias("initial_allowance"),
        remaining.alias("request_allowance"),
        F.greatest(F.lit(0).cast("bigint"), initial - remaining).alias("requests_used"),
    )
    if prefs is not None:
        p = prefs.select(F.col("cognito_sub").alias("owner_sub"), (F.col("is_payment_active") == 1).alias("_active"))
        out = out.join(p, "owner_sub", "left")
        active = F.coalesce(F.col("_active"), F.lit(False))
    else:
        active = F.lit(False)
    locked = F.lit(metered) & (F.col("request_allowance") <= 0) & ~active
    return out.withColumn("locked", locked).drop("_active")
