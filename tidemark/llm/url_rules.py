"""URL filter: written host and path rules, and association rules mined from labelled URLs.

1. *Tokens.*  A URL is the set of its scheme, host labels, whole host, path parts, query keys and a mark for a fragment;
   A-Z lower-cased, a run of digits written ``0``, so page numbers do not tell URLs apart.
2. *Mining.*  All minimal rules *tokens -> block* with the least support and the least confidence, over all tokens of
   every labelled URL, by sets of growing size (Apriori).  A set grows only while enough blocked URLs hold it, it is no rule
   itself (a rule that holds all tokens of another one adds nothing), and no part of it is held by the same URLs (that part
   would be the rule).  Candidates whose parts all remain are counted in the distinct token sets that hold their rarest token.
3. *Matching.*  Rules are listed under their rarest token.  The distinct token sets of all URLs look their tokens up in
   that index and check the rest of each rule found.  A URL that no written rule fits is blocked if a mined rule fits, else allowed.

Only DataFrame functions; no Python code runs in the tasks.

Defined cases.  A null URL or one without ``://`` has empty host and path and no tokens: no rule fits it, it is allowed.
A URL without a path fits no written rule, as each asks for a path.  Labels: URLs that come with several labels keep each; null labels are
left out; without labelled URLs, or with none blocked, nothing is mined.  Repeated rows count and return each; an empty
table gives no rows; other columns are ignored.  Rows of equal token sets share one lookup, so a very common URL is no
heavier than a rare one.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: The written rules, host and path and verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Mining: a rule holds in at least one of so many labelled URLs, and in at least so many URLs; least confidence.
ONE_IN = 500
MIN_URLS = 20
MIN_CONFIDENCE = 0.8
#: The SQL twin lists all subsets of so many tokens of a URL; :func:`mine` has no such limit.
MINED_TOKENS = 10
#: The label's place among the tokens; no token looks like it, as each has a kind before a colon.
BLOCK = "block"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (up to ``/``, ``?``, ``#``; A-Z lower-cased) and path (then up to ``?``, ``#``), empty where there is none."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def written_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest written rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules if rules is not None else RULES, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """The sorted distinct tokens of a URL; an empty array where there is no ``://``."""
    u = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, UPPER.lower()), "[0-9]+", "0")

    def parts(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))

    scheme = F.regexp_extract(u, r"(?s)^(.*?)://", 1)
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(u, r"(?s)^.*?://[^#]*(#)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    tokens = F.concat(parts("scheme", F.array(scheme)), parts("site", F.array(host)), parts("host", F.split(host, r"\.")),
                      parts("path", F.split(path, "/")), parts("query", keys), parts("mark", F.array(fragment)))
    return F.when(F.contains(u, F.lit("://")), F.array_sort(F.array_distinct(tokens))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, one_in: int = ONE_IN, min_urls: int = MIN_URLS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``tokens array<string>, anchor, n_urls, confidence``: all minimal rules *tokens -> block* of ``labelled``
    (``url, blocked boolean``)."""
    nothing = labelled.sparkSession.range(0).selectExpr("CAST(NULL AS ARRAY<STRING>) AS tokens", "'' AS anchor", "id AS n_urls", "0D AS confidence")
    rows = stored(labelled.where(F.col("blocked").isNotNull()).select(url_tokens(F.col("url")).alias("tokens"), F.col("blocked").cast("boolean"))
                  .groupBy("tokens", "blocked").agg(F.count(F.lit(1)).alias("n")), "labelled")
    total, blocked = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("blocked"), F.col("n"))), F.lit(0))).first()
    if not blocked:
        return nothing
    least = max(min_urls, -(-total // one_in))
    n_blocked = F.coalesce(F.sum(F.when(F.col("blocked"), F.col("n"))), F.lit(0)).alias("n_blocked")
    totals = F.sum("n").alias("n_urls"), n_blocked
    singles = rows.select(F.explode("tokens").alias("token"), "blocked", "n").groupBy("token").agg(*totals)
    level = singles.select(F.array("token").alias("tokens"), F.struct("n_urls", "token").alias("anchor"), "n_urls", "n_blocked")
    sure = F.col("n_blocked") / F.col("n_urls") >= min_confidence
    found = []
    for size in itertools.count(1):
        level = stored(level.where(F.col("n_blocked") >= least), "token_sets")
        found.append(level.where(sure))
        growing = level.where(~sure)
        if size == 1:
            known = growing.select(F.col("anchor.token").alias("token"))
            kept = rows.withColumn("id", F.monotonically_increasing_id()).select("id", "blocked", "n", F.explode("tokens").alias("token"))
            rows = stored(kept.join(known, "token", "left_semi").groupBy("id", "blocked", "n").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
                          .groupBy("tokens", "blocked").agg(F.sum("n").alias("n")), "labelled")
            pairs = F.flatten(F.transform("tokens", lambda x, i: F.transform(
                F.slice(F.col("tokens"), i + 2, F.size("tokens")), lambda y: F.array(x, y))))
            counted = _with_parts(rows.select(F.explode(pairs).alias("tokens"), "blocked", "n").groupBy("tokens").agg(*totals), growing)
        else:
            candidates = stored(_with_parts(_grown(growing, size), growing), "candidates")
            if candidates.isEmpty():
                break
            needs = candidates.select(F.col("tokens").alias("needs"), F.col("anchor.token").alias("token"))
            held = (rows.select("tokens", "blocked", "n", F.explode("tokens").alias("token")).join(needs, "token")
                    .where(F.size(F.array_except("needs", "tokens")) == 0))
            counted = held.groupBy(F.col("needs").alias("tokens")).agg(*totals).join(candidates, "tokens")
        # as many URLs as a part of it has: the same URLs, so neither it nor a larger set is a minimal rule
        level = counted.where(F.col("n_urls") < F.col("fewest")).select("tokens", "anchor", "n_urls", "n_blocked")
    return reduce(DataFrame.unionByName, found).select(
        "tokens", F.col("anchor.token").alias("anchor"), "n_urls", (F.col("n_blocked") / F.col("n_urls")).alias("confidence"))


def _grown(sets: DataFrame, size: int) -> DataFrame:
    """Sets of one token more: two sorted sets that differ only in their last token."""
    cut = sets.select(F.slice("tokens", 1, size - 1).alias("head"), F.element_at("tokens", -1).alias("last"))
    other = cut.select("head", F.col("last").alias("next"))
    return cut.join(other, "head").where(F.col("last") < F.col("next")).select(F.concat("head", F.array("last", "next")).alias("tokens"))


def _with_parts(sets: DataFrame, known: DataFrame) -> DataFrame:
    """The sets whose parts of one token less are all known, with their rarest token and the ``fewest`` URLs of a part."""
    part = F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("part")
    parts = sets.select("tokens", part).join(known.select(F.col("tokens").alias("part"), "anchor", "n_urls"), "part")
    whole = parts.groupBy("tokens").agg(F.count(F.lit(1)).alias("n_parts"), F.min("anchor").alias("anchor"), F.min("n_urls").alias("fewest"))
    return sets.join(whole.where(F.col("n_parts") == F.size("tokens")).drop("n_parts"), "tokens")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, mined``: the token sets (column ``tokens``) that a rule fits, with the surest rule's tokens as text."""
    index = rules.select("anchor", F.col("tokens").alias("needs"), "confidence")
    looked_up = sets.select("tokens", F.explode("tokens").alias("anchor")).join(index, "anchor").where(
        F.size(F.array_except("needs", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("rank"), F.array_join("needs", " ").alias("text")))
    return looked_up.groupBy("tokens").agg(best["text"].alias("mined"))


def filter_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", **mining) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined``: one row for each page (``page_id, url``); ``labelled``: see :func:`mine`."""
    host, path = host_path(F.col("url"))
    cut = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), url_tokens(F.col("url")).alias("tokens"))
    rules = stored(mine(labelled, **mining), "url_rules")
    name, verdict = written_rule(F.col("host"), F.col("path"))
    open_sets = cut.where(written_rule(F.col("host"), F.col("path"))[0].isNull()).select("tokens").distinct()
    hits = stored(matched(open_sets, rules), "url_hits")
    judged = cut.join(hits, "tokens", "left")
    return judged.select("page_id", "host", "path", name.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("mined").isNotNull(), BLOCK).otherwise("allow")).alias("verdict"),
                         F.when(name.isNull(), F.col("mined")).alias("mined"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, blocked`` of the pages whose last path number is a labelled document: blocked if that is toxic or of low quality.

    A document with several labels is blocked if one of them says so; a label without either mark is left out.
    """
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(bad).alias("blocked")).where("doc IS NOT NULL")
    number = F.regexp_extract(host_path(F.col("url"))[1], r"(?s)([0-9]+)[^0-9]*$", 1).try_cast("long")
    return pages.select("url", number.alias("doc")).join(marks, "doc").select("url", "blocked")
