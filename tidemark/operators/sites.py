"""Site records: cleaning (names, domains as host names, compliance level, plan defaults), creation and update.

An update names only the fields it sets.  Each field is a register of its own: of all updates that set it the one with the
latest ``updated_at`` counts (ties: the largest value), and ``versions`` keeps that time per field.  So updates may come
in any order, in any number of batches and more than once, and the table ends up the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .usage import FREE_ALLOWANCE, FREE_TIER

LEVELS = ["yes", "maybe", "no"]

_HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^@/?#]*@)?([^:/?#]*)"
_BAD_HOST_RE = r"[\s<>^|%\[\]\\]"


def domain_host(d: Column) -> Column:
    """One domain entry -> host name (an entry without ``://`` is read as ``http://entry``)."""
    t = F.trim(d)
    url = F.when(t.contains("://"), t).otherwise(F.concat(F.lit("http://"), t))
    h = F.lower(F.regexp_extract(url, _HOST_RE, 2))
    return F.when((h != "") & ~h.rlike(_BAD_HOST_RE), h)


def _name_error(name: Column) -> Column:
    return F.when(F.trim(name) == "", F.lit("name must be a non-empty string"))


def _domains_error(doms: Column) -> Column:
    return (
        F.when(F.size(doms) == 0, F.lit("domains must be a non-empty array"))
        .when(F.exists(doms, lambda d: d.isNull() | (F.trim(d) == "")), F.lit("domains must contain only non-empty strings"))
        .when(F.exists(F.transform(doms, domain_host), lambda h: h.isNull()), F.lit("invalid domain format"))
    )


def _fields_error(fields: Column) -> Column:
    return F.when(F.exists(fields, lambda f: f.isNull()), F.lit("allowed_fields must contain only strings"))


def _level_error(lvl: Column) -> Column:
    return F.when(~lvl.isin(LEVELS), F.lit("compliance_level must be yes, maybe or no"))


def clean_sites(raw: DataFrame) -> DataFrame:
    """Validated site rows with an ``error`` column (null when the row is valid).

    Name trimmed and non-blank; domains a non-empty list of non-blank entries,
    each turned into its host name and de-duplicated (first occurrence kept);
    compliance level yes/maybe/no, default maybe; new rows get the free plan
    and its allowance.
    """
    doms = F.col("domains")
    hosts = F.transform(doms, domain_host)
    name = F.trim(F.col("name"))
    lvl = F.col("compliance_level")
    error = F.coalesce(
        F.when(F.col("name").isNull(), F.lit("name must be a non-empty string")), _name_error(F.col("name")),
        F.when(doms.isNull(), F.lit("domains must be a non-empty array")), _domains_error(doms),
        _fields_error(F.col("allowed_fields")) if "allowed_fields" in raw.columns else F.lit(None), _level_error(lvl),
    )
    cols = raw.columns
    out = raw.withColumn("error", error).withColumn("name", name).withColumn("domains", F.array_distinct(hosts)).withColumn(
        "compliance_level", F.coalesce(lvl, F.lit("maybe"))
    )
    if "plan" in cols:
        out = out.withColumn("plan", F.coalesce(F.col("plan"), F.lit(FREE_TIER)))
    else:
        out = out.withColumn("plan", F.lit(FREE_TIER))
    if "request_allowance" in cols:
        out = out.withColumn("request_allowance", F.coalesce(F.col("request_allowance"), F.lit(FREE_ALLOWANCE)).cast("bigint"))
    else:
        out = out.withColumn("request_allowance", F.lit(FREE_ALLOWANCE).cast("bigint"))
    return out.select(*[c for c in out.columns if c != "error"], "error")


# The fields an update may set, and those the sites table keeps a version of.
UPDATABLE = ["name", "domains", "plan", "allowed_fields", "compliance_level"]
VERSIONS = T.MapType(T.StringType(), T.TimestampType())


def create_sites(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """New site records from ``requests`` (``site_id, owner_sub, name, domains, allowed_fields, compliance_level, created_at``).

    Every request comes back with ``status``: 201 and a complete record (free plan and its allowance, no allowed fields
    unless given, ``updated_at`` = ``created_at``), 400 with ``error``, or 409 where the id is taken, by a record that
    exists or by an earlier valid request (by time, then by content).
    """
    made = clean_sites(requests.drop("plan", "request_allowance")).withColumn("updated_at", F.col("created_at")).withColumn(
        "allowed_fields", F.coalesce("allowed_fields", F.array().cast("array<string>")))
    order = [F.col(c) for c in ("created_at", "owner_sub", "name", "domains", "allowed_fields", "compliance_level")]
    first = F.row_number().over(Window.partitionBy("site_id", F.col("error").isNotNull()).orderBy(*order)) == 1
    taken = existing.select("site_id", F.lit(True).alias("_taken")).distinct()
    made = made.withColumn("_first", first).join(taken, "site_id", "left")
    status = F.when(F.col("error").isNotNull(), 400).when(F.col("_taken") | ~F.col("_first"), 409).otherwise(201)
    return made.select(*[f.name for f in S.SITES.fields], "error", status.alias("status"))


def check_updates(sites: DataFrame, updates: DataFrame, metered: bool = True) -> DataFrame:
    """Each update (``site_id, owner_sub, updated_at`` and the fields to set, null where not set) with ``status`` 200, 400 or
    404 (no such site of this owner) and ``error``; names, domains as they are to be stored."""
    doms = F.col("domains")
    error = F.coalesce(
        F.when(F.coalesce(*[F.col(c).cast("string") for c in UPDATABLE]).isNull(), F.lit("at least one field is required")),
        _name_error(F.col("name")), _domains_error(doms),
        F.when(F.lit(not metered) & (F.col("plan") != FREE_TIER), F.lit("only the free plan without payments")),
        _fields_error(F.col("allowed_fields")), _level_error(F.col("compliance_level")),
    )
    owned = sites.select("site_id", "owner_sub", F.lit(True).alias("_owned")).distinct()
    out = updates.withColumn("error", error).join(owned, ["site_id", "owner_sub"], "left")
    status = F.when(F.col("error").isNotNull(), 400).when(F.col("_owned"), 200).otherwise(404)
    return out.withColumn("status", status).withColumn("name", F.trim("name")).withColumn(
        "domains", F.array_distinct(F.transform(doms, domain_host))).drop("_owned")


def update_sites(sites: DataFrame, updates: DataFrame, metered: bool = True) -> DataFrame:
    """``sites`` (with or without ``versions``) after all valid updates, with ``versions``.

    One grouped maximum per field over the updates (combined map-side, so one site with very many of them is no harm) and
    one join.
    """
    has = "versions" in sites.columns
    ok = check_updates(sites, updates, metered).where(F.col("status") == 200)
    latest = ok.groupBy("site_id").agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("updated_at").alias("t"), F.col(c).alias("v")))).alias(f"_{c}") for c in UPDATABLE])
    j = sites.join(latest, "site_id", "left")
    old = F.coalesce(F.col("versions"), F.create_map().cast(VERSIONS)) if has else F.create_map().cast(VERSIONS)
    values, times = {}, {}
    for c in UPDATABLE:
        new, since = F.col(f"_{c}"), F.try_element_at(old, F.lit(c))
        # a tie in time goes to the larger value, whichever came first
        wins = new.isNotNull() & (since.isNull() | (new["t"] > since) | ((new["t"] == since) & (new["v"] > F.col(c))))
        values[c] = F.when(wins, new["v"]).otherwise(F.col(c))
        times[c] = F.when(wins, new["t"]).otherwise(since)
    versions = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in UPDATABLE]), F.array(*times.values())), lambda _k, t: t.isNotNull())
    touched = F.array_max(F.map_values(versions))
    stored = [values[f.name].alias(f.name) if f.name in values else
              F.greatest("updated_at", touched).alias(f.name) if f.name == "updated_at" else F.col(f.name) for f in S.SITES.fields]
    return j.select(*stored, versions.alias("versions"))
