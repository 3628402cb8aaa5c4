"""User-agent text -> browser, OS and device fields, by ordered rule tables.

A small stand-in for a full user-agent parser library (parity with such a
library is not a goal): the first matching rule of each table wins.  Every
rule is a JVM regex evaluated inside whole-stage codegen - no Python UDF.
Patterns avoid look-arounds so the same table also runs in RE2-based engines.
A rule ends with a plain text (or several to choose from) that every match of
its pattern holds: the regex runs only on agents with that text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (pattern, name, version group or 0, text in every match). Order matters: first match wins.
BROWSER_RULES: list[tuple[str, str, int, str | tuple[str, ...]]] = [
    (r"Edg(e|A|iOS)?/([0-9][0-9.]*)", "Edge", 2, "Edg"),
    (r"(OPR|Opera)/([0-9][0-9.]*)", "Opera", 2, ("OPR/", "Opera/")),
    (r"SamsungBrowser/([0-9][0-9.]*)", "Samsung Internet", 1, "SamsungBrowser/"),
    (r"YaBrowser/([0-9][0-9.]*)", "Yandex", 1, "YaBrowser/"),
    (r"UCBrowser/([0-9][0-9.]*)", "UCBrowser", 1, "UCBrowser/"),
    (r"CriOS/([0-9][0-9.]*)", "Mobile Chrome", 1, "CriOS/"),
    (r"FxiOS/([0-9][0-9.]*)", "Mobile Firefox", 1, "FxiOS/"),
    (r"HeadlessChrome/([0-9][0-9.]*)", "Chrome Headless", 1, "HeadlessChrome/"),
    (r"; wv\).*Chrome/([0-9][0-9.]*)", "Chrome WebView", 1, "; wv)"),
    (r"Android.*Chrome/([0-9][0-9.]*) Mobile", "Mobile Chrome", 1, "Android"),
    (r"Firefox/([0-9][0-9.]*)", "Firefox", 1, "Firefox/"),
    (r"Chrome/([0-9][0-9.]*)", "Chrome", 1, "Chrome/"),
    (r"Version/([0-9][0-9.]*).*Mobile.*Safari", "Mobile Safari", 1, "Version/"),
    (r"Version/([0-9][0-9.]*).*Safari", "Safari", 1, "Version/"),
    (r"MSIE ([0-9][0-9.]*)", "IE", 1, "MSIE "),
    (r"Trident/.*rv:([0-9][0-9.]*)", "IE", 1, "Trident/"),
    (r"(Googlebot|bingbot|DuckDuckBot|YandexBot)/([0-9][0-9.]*)", "Bot", 2, ("bot/", "Bot/")),
]

# (pattern, name, version group or 0, text in every match); versions written with '_' become '.'.
OS_RULES: list[tuple[str, str, int, str | tuple[str, ...]]] = [
    (r"Windows Phone( OS)? ([0-9][0-9.]*)", "Windows Phone", 2, "Windows Phone"),
    (r"Windows NT ([0-9][0-9.]*)", "Windows", 1, "Windows NT "),
    (r"(iPhone|iPad|iPod).* OS ([0-9][0-9_]*)", "iOS", 2, " OS "),
    (r"Mac OS X ([0-9][0-9_.]*)", "Mac OS", 1, "Mac OS X "),
    (r"Macintosh", "Mac OS", 0, "Macintosh"),
    (r"Android ([0-9][0-9.]*)", "Android", 1, "Android "),
    (r"Android", "Android", 0, "Android"),
    (r"CrOS [^ ]+ ([0-9][0-9.]*)", "Chrome OS", 1, "CrOS "),
    (r"Tizen ([0-9][0-9.]*)", "Tizen", 1, "Tizen "),
    (r"PlayStation ([0-9]+)", "PlayStation", 1, "PlayStation "),
    (r"Ubuntu", "Ubuntu", 0, "Ubuntu"),
    (r"Linux", "Linux", 0, "Linux"),
]

# Windows NT kernel version -> marketing version, as user-agent parsers report it.
WINDOWS_VERSIONS = {"10.0": "10", "6.3": "8.1", "6.2": "8", "6.1": "7", "6.0": "Vista", "5.1": "XP"}

# (pattern, type or None, vendor or None, model: literal, or "$n" for a capture group; text in every match)
DEVICE_RULES: list[tuple[str, str | None, str | None, str | None, str | tuple[str, ...]]] = [
    (r"iPad", "tablet", "Apple", "iPad", "iPad"),
    (r"iPhone", "mobile", "Apple", "iPhone", "iPhone"),
    (r"iPod", "mobile", "Apple", "iPod touch", "iPod"),
    (r"(SM-T[0-9A-Z]+)", "tablet", "Samsung", "$1", "SM-T"),
    (r"(SM-[0-9A-Z]+)", "mobile", "Samsung", "$1", "SM-"),
    (r"(Pixel [0-9][0-9A-Za-z ]*?)( Build|;|\))", "mobile", "Google", "$1", "Pixel "),
    (r"(Redmi [0-9A-Za-z ]+?|Mi [0-9A-Za-z ]+?)( Build|;|\))", "mobile", "Xiaomi", "$1", ("Redmi ", "Mi ")),
    (r"(SMART-TV|SmartTV|Tizen.*TV|Web0S|BRAVIA)", "smarttv", None, None, ("TV", "Web0S", "BRAVIA")),
    (r"(PlayStation [0-9]+)", "console", "Sony", "$1", "PlayStation "),
    (r"(Xbox( One| Series [XS])?)", "console", "Microsoft", "$1", "Xbox"),
    (r"Nintendo (Switch|WiiU|3DS)", "console", "Nintendo", "$1", "Nintendo "),
    (r"Android.*Mobile", "mobile", None, None, "Android"),
    (r"Android", "tablet", None, None, "Android"),
    (r"Macintosh", None, "Apple", "Macintosh", "Macintosh"),
]


def _matches(ua: Column, rule) -> Column:
    """Does the rule's pattern match?  The regex runs only where its plain text is found."""
    texts = rule[-1] if isinstance(rule[-1], tuple) else (rule[-1],)
    held = reduce(lambda a, b: a | b, [ua.contains(x) for x in texts])
    return held if texts == (rule[0],) else held & ua.rlike(rule[0])


def _rule_index(ua: Column, rules) -> Column:
    """1-based index of the first matching rule, 0 when none matches."""
    out = None
    for i, rule in enumerate(rules, start=1):
        cond = _matches(ua, rule)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out.otherwise(F.lit(0))


def _pick(idx: Column, values: list) -> Column:
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.when(idx > 0, F.element_at(arr, idx))


def _extract_by_rule(ua: Column, idx: Column, rules, group_of) -> Column:
    """The capture group of the matched rule only (one regex per row at run time)."""
    out = None
    for i, rule in enumerate(rules, start=1):
        g = group_of(rule)
        if g is None:
            continue
        v = F.regexp_extract(ua, rule[0], g)
        out = F.when(idx == i, v) if out is None else out.when(idx == i, v)
    if out is None:
        return F.lit(None).cast("string")
    return out.otherwise(F.lit(None).cast("string"))


def with_agent_fields(df: DataFrame, ua: Column | str, prefix: str = "") -> DataFrame:
    """Add ``device, browser, browser_version, os, os_version, model, manufacturer``
    (all null when the agent is null).  Rule indexes are computed once per table."""
    u = F.col(ua) if isinstance(ua, str) else ua
    df = df.withColumns({"_ua": u})
    u = F.col("_ua")
    df = df.withColumns({
        "_bi": _rule_index(u, BROWSER_RULES),
        "_oi": _rule_index(u, OS_RULES),
        "_di": _rule_index(u, DEVICE_RULES),
    })
    bi, oi, di = F.col("_bi"), F.col("_oi"), F.col("_di")
    bver = _extract_by_rule(u, bi, BROWSER_RULES, lambda r: r[2] or None)
    over = _extract_by_rule(u, oi, OS_RULES, lambda r: r[2] or None)
    mdl = _extract_by_rule(
        u, di, DEVICE_RULES, lambda r: int(r[3][1:]) if r[3] and r[3].startswith("$") else None
    )
    lit_model = _pick(di, [r[3] if r[3] and not r[3].startswith("$") else None for r in DEVICE_RULES])
    win = F.create_map(*[x for k, v in WINDOWS_VERSIONS.items() for x in (F.lit(k), F.lit(v))])
    # each text is cut out in a projection of its own: it is read more than once below
    df = df.withColumns({"_bx": bver, "_ox": over, "_mx": mdl})
    bver, over, mdl = F.col("_bx"), F.col("_ox"), F.col("_mx")
    df = df.withColumns({
        "_bv": F.when(bver != "", F.replace(bver, F.lit("_"), F.lit("."))),
        "_ov": F.when(over != "", F.replace(over, F.lit("_"), F.lit("."))),
        "_os": _pick(oi, [r[1] for r in OS_RULES]),
        "_dt": _pick(di, [r[1] for r in DEVICE_RULES]),
        "_vd": _pick(di, [r[2] for r in DEVICE_RULES]),
        "_md": F.coalesce(F.when(mdl != "", mdl), lit_model),
    })
    has = F.col("_ua").isNotNull()
    vm = F.concat_ws(" ", F.col("_vd"), F.coalesce(F.col("_md"), F.lit("undefined")))
    dev = F.when(F.col("_dt").isNotNull(), F.col("_dt")).when(F.col("_vd").isNotNull(), vm).otherwise(F.lit("desktop"))
    out = {
        "device": dev,
        "browser": _pick(bi, [r[1] for r in BROWSER_RULES]),
        "browser_version": F.col("_bv"),
        "os": F.col("_os"),
        "os_version": F.when(F.col("_os") == "Windows", F.coalesce(win[F.col("_ov")], F.col("_ov"))).otherwise(F.col("_ov")),
        "model": F.col("_md"),
        "manufacturer": F.col("_vd"),
    }
    tmp = {"_ua", "_bi", "_oi", "_di", "_bx", "_ox", "_mx", "_bv", "_ov", "_os", "_dt", "_vd", "_md"}
    outs = {prefix + k: F.when(has, v) for k, v in out.items()}
    keep = [F.col(c) for c in df.columns if c not in tmp and c not in outs]
    return df.select(*keep, *[v.alias(k) for k, v in outs.items()])
