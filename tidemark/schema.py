"""Column registry: the event tables, their privacy tags and the side tables.

Every table is declared once here and read with an explicit schema (no
inference).  Each event column carries a risk tag in its StructField metadata:

* ``yes``   - coarse or content data, no consent needed
* ``maybe`` - finer data, needs a privacy notice
* ``no``    - identifiers / fingerprint bits, needs consent
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S = T.StringType()


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    safe: str  # "yes" | "maybe" | "no"

    def struct_field(self) -> T.StructField:
        return T.StructField(self.name, self.type, True, metadata={"safe": self.safe})


PROPERTIES_TYPE = T.MapType(S, S)

# The common columns of both event tables, in table order, with tags.
COMMON_FIELDS: tuple[Field, ...] = (
    Field("site_id", S, "yes"),
    Field("dt", S, "yes"),
    Field("event", S, "yes"),
    Field("pathname", S, "yes"),
    Field("session_id", S, "yes"),
    Field("timestamp", T.TimestampType(), "yes"),
    Field("properties", PROPERTIES_TYPE, "maybe"),
)

# Columns sent only with the first event of a visit, in table order, with tags.
INITIAL_ONLY_FIELDS: tuple[Field, ...] = (
    Field("distinct_id", S, "no"),
    Field("model", S, "no"),
    Field("manufacturer", S, "no"),
    Field("city", S, "maybe"),
    Field("timezone", S, "maybe"),
    Field("browser_version", S, "maybe"),
    Field("os_version", S, "maybe"),
    Field("screen_height", S, "maybe"),
    Field("screen_width", S, "maybe"),
    Field("region", S, "yes"),
    Field("country", S, "yes"),
    Field("device", S, "yes"),
    Field("browser", S, "yes"),
    Field("os", S, "yes"),
    Field("referer", S, "yes"),
    Field("referer_domain", S, "yes"),
    Field("utm_source", S, "yes"),
    Field("utm_campaign", S, "yes"),
    Field("utm_medium", S, "yes"),
    Field("utm_content", S, "yes"),
    Field("utm_term", S, "yes"),
)

INITIAL_FIELDS: tuple[Field, ...] = COMMON_FIELDS + INITIAL_ONLY_FIELDS

LEVEL_RANK = {"yes": 0, "maybe": 1, "no": 2}
ALWAYS_KEPT = ("site_id", "timestamp", "dt")

# Columns that describe one event; every other column describes the visit and is
# spread over the session from its first row.
EVENT_COLUMNS = ("event", "pathname", "timestamp", "properties")

PARTITION_COLUMNS = ("site_id", "dt")


def struct(fields) -> T.StructType:
    return T.StructType([f.struct_field() for f in fields])


EVENTS = struct(COMMON_FIELDS)
INITIAL_EVENTS = struct(INITIAL_FIELDS)


def names(fields) -> list[str]:
    return [f.name for f in fields]


def safe_fields(fields) -> list[Field]:
    """Fields a query may return: tag yes or maybe, in declared order."""
    return [f for f in fields if f.safe in ("yes", "maybe")]


def allowed_fields(level: str | None, initial: bool) -> list[str]:
    """Field names a site at compliance ``level`` may store (default ``maybe``)."""
    level = level or "maybe"
    fields = INITIAL_FIELDS if initial else COMMON_FIELDS
    need = LEVEL_RANK[level]
    out = [f.name for f in fields if LEVEL_RANK[f.safe] <= need]
    for name in ALWAYS_KEPT:
        if name not in out:
            out.append(name)
    return out


# Report-layer form: properties travel as JSON text.
def view_struct(fields) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, S if f.name == "properties" else f.type, True, {"safe": f.safe})
            for f in fields
        ]
    )


REQUEST = T.StructType(
    [
        T.StructField("request_id", S),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("site", S),
        T.StructField("headers", T.MapType(S, S)),
        T.StructField("context_user_agent", S),
        T.StructField("body", S),
    ]
)

# Body fields the tracker sends. Screen sizes may be numbers or text: read as text.
BODY = T.StructType(
    [
        T.StructField("event", S),
        T.StructField("pathname", S),
        T.StructField("session_id", S),
        T.StructField("is_initial_event", S),
        T.StructField("properties", T.MapType(S, S)),
        T.StructField("screen_height", S),
        T.StructField("screen_width", S),
        T.StructField("referer", S),
        T.StructField("userAgent", S),
        T.StructField("utm_source", S),
        T.StructField("utm_campaign", S),
        T.StructField("utm_medium", S),
        T.StructField("utm_content", S),
        T.StructField("utm_term", S),
        # page URL: lets logs from other trackers carry utm_* in the URL query
        T.StructField("url", S),
    ]
)

REJECTS = T.StructType(
    [
        T.StructField("request_id", S),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("site", S),
        T.StructField("status", T.IntegerType()),
        T.StructField("reason", S),
        T.StructField("dt", S),
        T.StructField("body", S),
    ]
)

SITES = T.StructType(
    [
        T.StructField("site_id", S),
        T.StructField("owner_sub", S),
        T.StructField("name", S),
        T.StructField("domains", T.ArrayType(S)),
        T.StructField("plan", S),
        T.StructField("request_allowance", T.LongType()),
        T.StructField("allowed_fields", T.ArrayType(S)),
        T.StructField("compliance_level", S),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

PREFERENCES = T.StructType(
    [
        T.StructField("cognito_sub", S),
        T.StructField("stripe_customer_id", S),
        T.StructField("stripe_payment_method_id", S),
        T.StructField("stripe_last4", S),
        T.StructField("is_payment_active", T.IntegerType()),
    ]
)

OUTCOMES = T.StructType(
    [
        T.StructField("site_id", S),
        T.StructField("status", S),
        T.StructField("error_kind", S),
        T.StructField("message", S),
    ]
)

PAYMENT_EVENTS = T.StructType(
    [
        T.StructField("event_time", T.TimestampType()),
        T.StructField("type", S),
        T.StructField("user_sub", S),
        T.StructField("customer_id", S),
        T.StructField("payment_method_id", S),
        T.StructField("last4", S),
    ]
)

USAGE_LEDGER = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("site_id", S),
        T.StructField("used", T.LongType()),
        # totals of batches up to ``batch_id`` of one writer, as the ledger's merge leaves them
        T.StructField("merged", T.BooleanType()),
    ]
)
