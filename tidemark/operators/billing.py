"""Top-up billing as table operations.

The payment service's answer for each charge attempt comes in as an
``outcomes`` table (site_id, status, error_kind, message); this module
decides who is charged and applies the outcomes to the site and preference
tables.  Preferences are read as they were when the run started (the source
product re-reads them between sites of one owner; see README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plans, top-up size.
NEEDS_PAYMENT = "needs_payment"
ACTIVE_PAID = "active_paid"
PAYMENT_FAILED = "payment_failed"
TOPUP_REQUESTS = 500000
TOPUP_CENTS = 500


def _nonblank(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def charge_candidates(sites: DataFrame, prefs: DataFrame, plan: str = NEEDS_PAYMENT) -> DataFrame:
    """Sites on ``plan`` with their owner's payment readiness.

    ``ready``: preferences exist, payment active (= 1), customer and payment
    method set.  Sites not ready are skipped (no charge, no change).
    """
    c = sites.filter(F.col("plan") == plan).select("site_id", "owner_sub")
    p = prefs.select(
        F.col("cognito_sub").alias("owner_sub"), "is_payment_active", "stripe_customer_id", "stripe_payment_method_id"
    )
    j = c.join(p, "owner_sub", "left")
    ready = (
        (F.col("is_payment_active") == 1) & _nonblank(F.col("stripe_customer_id"))
        & _nonblank(F.col("stripe_payment_method_id"))
    )
    return j.withColumn("ready", F.coalesce(ready, F.lit(False)))


def method_problem(status: Column, kind: Column, message: Column) -> Column:
    """Does a failed charge point at the payment method?

    card errors: yes; invalid-request errors: when the message names the
    payment method or customer; an unexpected status text: yes; API and other
    errors: no (may be temporary)."""
    msg = F.lower(F.coalesce(message, F.lit("")))
    k = F.coalesce(kind, F.when(status != "succeeded", F.lit("text")))
    return (
        F.when(k == "card", True)
        .when(k == "invalid_request", msg.contains("paymentmethod") | msg.contains("customer"))
        .when(k == "text", True)
        .otherwise(False)
    )


def charge_results(sites: DataFrame, prefs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per charged (ready) site: succeeded?, method problem?"""
    ready = charge_candidates(sites, prefs).filter("ready").select("site_id", "owner_sub")
    o = outcomes.select("site_id", "status", "error_kind", "message")
    j = ready.join(o, "site_id", "inner")
    ok = F.col("status") == "succeeded"
    return j.select(
        "site_id", "owner_sub", ok.alias("succeeded"),
        (~ok & method_problem(F.col("status"), F.col("error_kind"), F.col("message"))).alias("method_problem"),
    )


def apply_outcomes(sites: DataFrame, prefs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sites after a charge run: success -> active_paid and +500,000 requests;
    failure -> payment_failed; skipped sites unchanged."""
    r = charge_results(sites, prefs, outcomes).select("site_id", "succeeded")
    j = sites.join(r, "site_id", "left")
    plan = F.when(F.col("succeeded"), F.lit(ACTIVE_PAID)).when(~F.col("succeeded"), F.lit(PAYMENT_FAILED)).otherwise(
        F.col("plan"))
    allow = F.when(F.col("succeeded"), F.col("request_allowance") + F.lit(TOPUP_REQUESTS)).otherwise(
        F.col("request_allowance"))
    return j.withColumn("plan", plan).withColumn("request_allowance", allow.cast("bigint")).select(*sites.columns)


def apply_pref_outcomes(prefs: DataFrame, sites: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Preferences after a charge run: an owner with a failed charge caused by
    the payment method gets ``is_payment_active = 0``."""
    bad = (
        charge_results(sites, prefs, outcomes).filter("method_problem")
        .select(F.col("owner_sub").alias("cognito_sub")).distinct()
        .withColumn("_off", F.lit(True))
    )
    j = prefs.join(bad, "cognito_sub", "left")
    return j.withColumn(
        "is_payment_active", F.when(F.col("_off"), F.lit(0)).otherwise(F.col("is_payment_active")).cast("int")
    ).select(*prefs.columns)


SETUP_SUCCEEDED = "setup_intent.succeeded"
METHOD_DETACHED = "payment_method.detached"


def apply_payment_events(prefs: DataFrame, events: DataFrame) -> DataFrame:
    """Payment event log -> preferences.

    setup succeeded (user, customer and method present): method, last4 set,
    payment active; only for users that exist.  method detached: the user
    with that customer id becomes inactive and loses method and last4.  The
    latest event per user decides (``max_by`` on event time, no window sort).
    """
    setup = events.filter(
        (F.col("type") == SETUP_SUCCEEDED) & _nonblank(F.col("user_sub")) & _nonblank(F.col("customer_id"))
        & _nonblank(F.col("payment_method_id"))
    ).select(F.col("user_sub").alias("cognito_sub"), "event_time", "type", "payment_method_id", "last4")
    by_customer = prefs.select("cognito_sub", F.col("stripe_customer_id").alias("customer_id"))
    detach = (
        events.filter((F.col("type") == METHOD_DETACHED) & _nonblank(F.col("customer_id")))
        .join(by_customer, "customer_id", "inner")
        .select("cognito_sub", "event_time", "type", F.lit(None).cast("string").alias("payment_method_id"),
                F.lit(None).cast("string").alias("last4"))
    )
    last = (
        setup.unionByName(detach)
        .groupBy("cognito_sub")
        .agg(F.max_by(F.struct("type", "payment_method_id", "last4"), F.struct("event_time", "type")).alias("_e"))
    )
    j = prefs.join(last, "cognito_sub", "left")
    is_setup = F.col("_e.type") == SETUP_SUCCEEDED
    is_detach = F.col("_e.type") == METHOD_DETACHED
    return j.select(
        "cognito_sub", "stripe_customer_id",
        F.when(is_setup, F.col("_e.payment_method_id")).when(is_detach, F.lit(None)).otherwise(
            F.col("stripe_payment_method_id")).alias("stripe_payment_method_id"),
        F.when(is_setup, F.col("_e.last4")).when(is_detach, F.lit(None)).otherwise(
            F.col("stripe_last4")).alias("stripe_last4"),
        F.when(is_setup, F.lit(1)).when(is_detach, F.lit(0)).otherwise(F.col("is_payment_active")).cast("int").alias(
            "is_payment_active"),
    )
