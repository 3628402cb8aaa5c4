"""Session model: both event tables -> one analytics view.

The view has one row per event; every visit column (everything except
``event, pathname, timestamp, properties``) carries the value of the
session's earliest row, and two derived columns, ``channel`` and ``source``,
are added.

Plan shape: the session table (one row per session) is one grouped aggregate:
``min_by`` finds the first row, partial aggregation collapses a hot session on the
map side, and most reports run on that much smaller table.  The event view asks
first whether any session is hot (:func:`hot_sessions`: one aggregate of the
session ids alone).  Without one, the view is a single window over the rows,
scanned and shuffled once.  With one, a window would put the hot session into one
task, so the first rows come from the session table by a join on the session key
in which hot sessions are salted.

Rows of a session are in a total order (:func:`order_columns`), so results do not
depend on how the input lies or in which order it was read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.text import is_blank
from ..plans.sizing import sized_broadcast
from ..session import scratch_path

# Referer domains the channel rule matches, as listed in the source product.
EMAIL_DOMAINS = ["mail.google.com", "com.google.android.gm"]
SOCIAL_DOMAINS = [
    "facebook", "twitter", "linkedin", "instagram", "pinterest", "reddit", "t.co",
    "facebook.com", "twitter.com", "linkedin.com", "instagram.com", "pinterest.com", "reddit.com",
    "com.reddit.frontpage", "old.reddit.com", "youtube.com", "m.youtube.com",
]
SEARCH_DOMAINS = [
    "google", "bing", "duckduckgo", "yahoo", "ecosia", "baidu",
    "google.com", "google.co.uk", "google.com.hk", "yandex.ru", "search.brave.com", "perplexity.ai",
]

SESSION_KEY = "session_id"


def view_columns(fields=None) -> list[str]:
    """Final column order of the view: event columns, filled columns, channel, source."""
    fields = fields if fields is not None else S.safe_fields(S.INITIAL_FIELDS)
    allc = S.names(fields)
    static = [c for c in allc if c not in S.EVENT_COLUMNS]
    return list(S.EVENT_COLUMNS) + static + ["channel", "source"]


def static_columns(fields=None) -> list[str]:
    fields = fields if fields is not None else S.safe_fields(S.INITIAL_FIELDS)
    return [c for c in S.names(fields) if c not in S.EVENT_COLUMNS]


def override_referer(initial: DataFrame) -> DataFrame:
    """First events with a non-blank ``utm_source``: it replaces ``referer_domain``."""
    return initial.withColumn(
        "referer_domain",
        F.when(~is_blank(F.col("utm_source")), F.col("utm_source")).otherwise(F.col("referer_domain")),
    )


def union_events(initial: DataFrame, events: DataFrame, fields=None) -> DataFrame:
    """UNION ALL of both tables; columns the regular table lacks are null.

    Extra columns present in both (e.g. a sequence number used to break
    timestamp ties) are kept after the declared ones.
    """
    fields = fields if fields is not None else S.safe_fields(S.INITIAL_FIELDS)
    declared = S.names(fields)
    initial, events = as_view_form(initial), as_view_form(events)
    u = initial.unionByName(events, allowMissingColumns=True)
    extra = [c for c in u.columns if c not in declared]
    present = [c for c in declared if c in u.columns]
    missing = [F.lit(None).cast(f.type if f.name != "properties" else "string").alias(f.name)
               for f in fields if f.name not in u.columns]
    return u.select(*present, *missing, *extra).select(*declared, *extra)


def as_view_form(df: DataFrame) -> DataFrame:
    """Lake form (properties map) -> report form (properties JSON text)."""
    if "properties" in df.columns and isinstance(df.schema["properties"].dataType, T.MapType):
        return df.withColumn("properties", F.to_json("properties"))
    return df


def order_columns(columns: list[str], seq_col: str | None = None) -> list[str]:
    """The columns that order a session's rows (D3): timestamp, a sequence column if given, event, path.  Without a
    sequence all other columns that may differ follow, so rows that still tie are alike in all that a view shows."""
    out = ["timestamp"] + ([seq_col] if seq_col and seq_col in columns else []) + ["event", "pathname"]
    if len(out) < 4:
        out += ["properties"] + [f.name for f in S.INITIAL_FIELDS]
    return [c for c in dict.fromkeys(out) if c in columns and c != SESSION_KEY]


def order_key(df: DataFrame, seq_col: str | None = None) -> Column:
    """Row order inside a session as one comparable value (nulls first, as in a window)."""
    return F.struct(*[F.col(c) for c in order_columns(df.columns, seq_col)])


def referer_or_direct() -> Column:
    # COALESCE(referer_domain, '$direct', 'Unknown'): the third value is unreachable (D5).
    return F.coalesce(F.col("referer_domain"), F.lit("$direct"))


def channel_expr() -> Column:
    medium = F.col("utm_medium")
    d = F.lower(referer_or_direct())
    return (
        F.when((medium == "cpc") | (medium == "ppc"), "Paid Search")
        .when((medium == "email") | d.isin(EMAIL_DOMAINS), "Email")
        .when((medium == "social") | d.isin(SOCIAL_DOMAINS), "Social")
        .when(d.isin(SEARCH_DOMAINS), "Organic Search")
        .when(d == "$direct", "Direct")
        .otherwise("Referral")
    )


def source_expr() -> Column:
    r = referer_or_direct()
    return F.when(r == "$direct", F.lit("$direct")).otherwise(
        F.regexp_replace(F.lower(F.trim(r)), r"^www\.", "")
    )


def with_channel(df: DataFrame) -> DataFrame:
    return df.withColumn("channel", channel_expr())


def with_source(df: DataFrame) -> DataFrame:
    return df.withColumn("source", source_expr())


def is_page_view() -> Column:
    return F.col("event") == "page_view"


def real_page() -> Column:
    """A page_view with a non-blank pathname (entry/exit/top pages)."""
    return is_page_view() & F.col("pathname").isNotNull() & (F.trim(F.col("pathname")) != "")


# Null-safe session key: a null session_id is one group (as a window partition
# would be).  Grouping and joining on the pair (_sk, _sn) lets the session
# aggregate's hash partitioning be reused by the join back to the rows.
SK, SN = "_sk", "_sn"


def with_session_key(df: DataFrame) -> DataFrame:
    return df.withColumn(SK, F.coalesce(F.col(SESSION_KEY), F.lit(""))).withColumn(SN, F.col(SESSION_KEY).isNull())


# A session with more rows than this is hot: no single task may hold it.  In joins by session key its rows are
# spread over ceil(n_rows / HOT_SESSION_ROWS) salts.  A table of N rows has fewer than N / HOT_SESSION_ROWS of them.
HOT_SESSION_ROWS = 1_000_000


def hot_sessions(base: DataFrame, min_rows: int | None = None) -> DataFrame | None:
    """``_sk, _sn, _salts`` of all sessions above ``min_rows`` rows, as a stored table; None if there is none.

    Runs one job over the session ids (combined map-side), and a second one only if something is hot.
    """
    min_rows = min_rows or HOT_SESSION_ROWS
    found = base.groupBy(SK, SN).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > min_rows).select(
        SK, SN, F.ceil(F.col("n_rows") / F.lit(min_rows)).cast("int").alias("_salts"))
    if found.isEmpty():
        return None
    spark = base.sparkSession
    path = scratch_path(spark, "hot-sessions", uuid.uuid4().hex)
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def salted_session_join(rows: DataFrame, sess: DataFrame, how: str, hot: DataFrame, spread: list[Column]) -> DataFrame:
    """Join event rows to a one-row-per-session frame on the session key, with
    hot sessions salted: their rows get a salt from a hash of ``spread``, and
    their session row is repeated once per salt, so one huge session is
    joined by many tasks instead of one.  ``hot`` (:func:`hot_sessions`) is a stored
    table, broadcast when its size allows; None joins on the key alone."""
    if hot is None:
        return rows.join(sess, [SK, SN], how)
    h = sized_broadcast(hot)
    r = rows.join(h, [SK, SN], "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts")))
    ).drop("_salts")
    s = sess.join(h, [SK, SN], "left").withColumn(
        "_salt", F.explode(F.when(F.col("_salts").isNull(), F.array(F.lit(0)))
                           .otherwise(F.sequence(F.lit(0), F.col("_salts") - 1)))
    ).drop("_salts")
    return r.join(s, [SK, SN, "_salt"], how).drop("_salt")


@dataclass(frozen=True)
class Analytics:
    """The analytics view, kept as raw rows + session table.

    ``base``: the union of both tables (event columns, ``session_id``, the
    optional sequence column, session key), before filling.
    ``sessions``: one row per session with the filled visit columns, channel,
    source and the facts ``n_rows, n_pageviews, first_ts, last_ts,
    entry_page, exit_page``.  ``rows`` (the view itself) is ``base`` joined to
    ``sessions``; narrowing ``sessions`` (segments) therefore narrows the view
    with the same single shuffle of the raw rows.
    """

    base: DataFrame
    sessions: DataFrame
    static: tuple[str, ...]
    seq_col: str | None = None
    narrowed: bool = False
    hot_of: "Analytics | None" = None

    def _spread(self) -> list[Column]:
        return [F.col("timestamp")] + ([F.col(self.seq_col)] if self.seq_col else [F.col("event")])

    @cached_property
    def hot(self) -> DataFrame | None:
        """The hot sessions of all rows (a superset of a narrowed view's), looked for once."""
        return self.hot_of.hot if self.hot_of is not None else hot_sessions(self.base)

    def event_rows(self) -> DataFrame:
        """Raw rows of the kept sessions (event columns only, no fill needed)."""
        return self._event_rows

    @cached_property
    def _event_rows(self) -> DataFrame:
        # built once per instance, so all reports on it share one plan
        if not self.narrowed:
            return self.base
        return salted_session_join(self.base, self.sessions.select(SK, SN), "left_semi", self.hot, self._spread())

    @cached_property
    def rows(self) -> DataFrame:
        keep = list(S.EVENT_COLUMNS) + ([self.seq_col] if self.seq_col else [])
        cols = list(S.EVENT_COLUMNS) + list(self.static) + ["channel", "source"] + keep[len(S.EVENT_COLUMNS):]
        if not self.narrowed and self.hot is None:
            filled = _first_row_fill(self.base, [c for c in self.static if c != SESSION_KEY], self.seq_col)
            return filled.withColumn("channel", channel_expr()).withColumn("source", source_expr()).select(*cols)
        b = self.base.select(*keep, SK, SN)
        filled = self.sessions.select(SK, SN, *self.static, "channel", "source")
        return salted_session_join(b, filled, "inner", self.hot, self._spread()).select(*cols)

    def with_sessions(self, sessions: DataFrame) -> "Analytics":
        return Analytics(self.base, sessions, self.static, self.seq_col, True, self.hot_of or self)

    def persist(self) -> "Analytics":
        return Analytics(self.base.persist(), self.sessions.persist(), self.static, self.seq_col, self.narrowed, self.hot_of or self)

    def unpersist(self) -> None:
        self.base.unpersist()
        self.sessions.unpersist()


def _first_row_fill(keyed: DataFrame, static: list[str], seq_col: str | None) -> DataFrame:
    """Each row with the visit columns of its session's first row, by one window per session."""
    w = Window.partitionBy(SK, SN).orderBy(*order_columns(keyed.columns, seq_col))
    filled = keyed.withColumn("_first", F.first(F.struct(*static)).over(w))
    return filled.select(*[F.col(f"_first.{c}").alias(c) if c in static else F.col(c) for c in keyed.columns])


def session_table(base: DataFrame, static: list[str], seq_col: str | None = None,
                  flags: dict[str, Column] | None = None) -> DataFrame:
    """One grouped pass over the raw rows: the session's first row + session facts (+ for each of ``flags`` whether some
    row meets it)."""
    ok = order_key(base, seq_col)
    page = real_page()
    vis = [c for c in static if c != SESSION_KEY]
    agg = base.groupBy(SK, SN).agg(
        F.min_by(F.struct(*[F.col(c) for c in vis]), ok).alias("_first"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_page_view()).alias("n_pageviews"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.min_by(F.col("pathname"), F.when(page, ok)).alias("entry_page"),
        F.max_by(F.col("pathname"), F.when(page, ok)).alias("exit_page"),
        *[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in (flags or {}).items()],
    )
    facts = [c for c in agg.columns if c not in (SK, SN, "_first")]
    agg = agg.select(
        SK, SN, F.when(~F.col(SN), F.col(SK)).alias(SESSION_KEY), "_first.*", *facts
    )
    ordered = [SK, SN] + list(static) + facts
    return agg.select(*ordered).withColumn("channel", channel_expr()).withColumn("source", source_expr())


def scope_sessions_by_site(df: DataFrame) -> DataFrame:
    """Make ``session_id`` site-scoped (``site_id:session_id``); a null id stays null."""
    sid = F.col(SESSION_KEY)
    return df.withColumn(SESSION_KEY, F.when(sid.isNotNull(), F.concat_ws(":", F.coalesce("site_id", F.lit("")), sid)))


def build(initial: DataFrame, events: DataFrame, seq_col: str | None = None,
          utm_override: bool = True, fields=None, session_key: tuple[str, ...] = (SESSION_KEY,)) -> Analytics:
    """Both tables -> Analytics (the view and its session table).

    ``session_key``: ``("session_id",)`` (default, as the source product keys
    sessions, D24) or ``("site_id", "session_id")`` to keep equal session ids
    of different sites apart (the view then shows ``site_id:session_id``).
    """
    if tuple(session_key) == ("site_id", SESSION_KEY):
        initial, events = scope_sessions_by_site(initial), scope_sessions_by_site(events)
    elif tuple(session_key) != (SESSION_KEY,):
        raise ValueError(f"session_key must be ('session_id',) or ('site_id', 'session_id'), not {session_key!r}")
    fields = fields if fields is not None else S.safe_fields(S.INITIAL_FIELDS)
    static = static_columns(fields)
    if SESSION_KEY not in static:
        raise ValueError("session_id column is missing; the view cannot be built")
    if utm_override and "utm_source" in initial.columns:
        initial = override_referer(initial)
    base = with_session_key(union_events(initial, events, fields))
    seq = seq_col if seq_col and seq_col in base.columns else None
    sessions = session_table(base, static, seq)
    return Analytics(base, sessions, tuple(static), seq)


def analytics(initial: DataFrame, events: DataFrame, **kw) -> DataFrame:
    """The analytics view as one DataFrame (register it with createOrReplaceTempView)."""
    return build(initial, events, **kw).rows


def fill_session(df: DataFrame, mode: str = "first_row", seq_col: str | None = None,
                 chunk_us: int = 1_000_000) -> DataFrame:
    """Spread the visit columns of an already unioned table over each session.

    ``first_row`` (what the source product computes, D1): every row takes the
    session's earliest row, nulls included.  ``forward``: the documented aim, the last
    non-null value up to each row.  Both are one window per session; if a session is
    hot, the first row comes from a grouped ``min_by`` and a salted join, and the forward
    fill cuts the session into time chunks (``chunk_us``) whose last non-null
    values are carried across chunk borders, so a huge session is spread over many tasks.
    """
    fields = [f for f in S.safe_fields(S.INITIAL_FIELDS) if f.name in df.columns]
    static = [c for c in static_columns(fields) if c != SESSION_KEY]
    keyed = with_session_key(df)
    if mode == "first_row":
        hot = hot_sessions(keyed)
        if hot is None:
            return _first_row_fill(keyed, static, seq_col).select(*df.columns)
        first = keyed.groupBy(SK, SN).agg(F.min_by(F.struct(*static), order_key(df, seq_col)).alias("_first"))
        spread = [F.col(c) for c in order_columns(df.columns, seq_col)[:2]]
        out = salted_session_join(keyed.drop(*static), first.select(SK, SN, "_first.*"), "inner", hot, spread)
        return out.select(*df.columns)
    if mode == "forward":
        return _forward_fill(keyed, df.columns, static, seq_col, chunk_us)
    raise ValueError(f"unknown fill mode {mode!r}")


def _forward_fill(keyed: DataFrame, columns: list[str], static: list[str], seq_col: str | None, chunk_us: int) -> DataFrame:
    order = order_columns(columns, seq_col)
    running = (Window.unboundedPreceding, Window.currentRow)
    hot = hot_sessions(keyed)
    if hot is None:
        w = Window.partitionBy(SK, SN).orderBy(*order).rowsBetween(*running)
        return keyed.select(*[F.last(F.col(c), ignorenulls=True).over(w).alias(c) if c in static else F.col(c) for c in columns])
    flag = hot.select(SK, SN, F.lit(True).alias("_hot"))
    keyed = keyed.join(sized_broadcast(flag), [SK, SN], "left").withColumn(
        "_chunk", F.when(F.col("_hot"), F.floor(F.unix_micros("timestamp") / F.lit(chunk_us))).otherwise(F.lit(0))
        .cast("bigint")).drop("_hot")
    part = [SK, SN, "_chunk"]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(*running)
    ok = F.struct(*order)
    summ = keyed.groupBy(*part).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ok)).alias(f"_l_{c}")
                                      for c in static])
    cw = Window.partitionBy(SK, SN).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*part, *[F.last(f"_l_{c}", ignorenulls=True).over(cw).alias(f"_c_{c}") for c in static])
    local = keyed.select(*[c for c in keyed.columns if c not in static],
                         *[F.last(F.col(c), ignorenulls=True).over(w).alias(c) for c in static])
    j = local.join(summ, part)
    return j.select(*[F.coalesce(F.col(c), F.col(f"_c_{c}")).alias(c) if c in static else F.col(c) for c in columns])
