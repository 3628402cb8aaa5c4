"""URL parts as Column expressions, close to browser URL parsing.

Built-in ``parse_url`` keeps host case and gives up on many inputs a browser
accepts (D13), so the parts are taken with regular expressions:

* scheme ``[A-Za-z][A-Za-z0-9+.-]*`` followed by ``:``; none -> invalid.
* web schemes (http, https, ws, wss, ftp): leading slashes after the scheme are
  optional, the host is lower-cased, an empty host is invalid, an empty path is
  ``/``, dot segments of the path are resolved, characters that a path may not hold
  are percent-encoded by UTF-8 byte, and the origin is ``scheme://host[:port]`` (default ports dropped).
* other schemes: a host exists only after ``//``; its case is kept; the origin
  is ``scheme://host`` (a browser would print ``null``; see D13).

``with_url_parts`` adds all parts as one struct column, computing each
intermediate once (one projection per step) so generated code stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEB_SCHEMES = ["http", "https", "ws", "wss", "ftp"]
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

# characters a host may not contain
_BAD_HOST_RE = r"[\s<>^|%\[\]\\]"

# characters that stand in a browser's path as they are; a run of them, or one other character
_PATH_PIECES = r"(?s)([\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E]+|.)"
_ODD_IN_PATH = r"(?s)[^\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E]"
_DOT_SEGMENT = r"(?i)/(\.|%2e){1,2}(/|$)"

FIELDS = ["scheme", "host", "port", "path", "query", "origin", "valid"]


# One pattern for all parts: scheme, leading slashes, authority, path, ?query, #fragment.
_MASTER_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):([/\\]*)([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_SEP = "\u0001"


def encode_path(path: Column) -> Column:
    """Percent-encode, byte by byte, what a browser encodes in a web URL's path (``%`` itself stays)."""
    encoded = F.transform(F.regexp_extract_all(path, F.lit(_PATH_PIECES), F.lit(1)), lambda x: F.when(
        x.rlike(_ODD_IN_PATH), F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")).otherwise(x))
    return F.when(path.rlike(_ODD_IN_PATH), F.array_join(encoded, "")).otherwise(path)


def remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments (``%2e`` counts as a dot) of a path that begins with a slash."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    marked = F.transform(parts, lambda x, i: F.struct(
        x.alias("x"), F.regexp_replace(x, "(?i)%2e", ".").alias("dots"), (i == F.size(parts) - 1).alias("last")))

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        base = F.when(part["dots"] == "..", up).otherwise(done)
        # a dot segment at the end leaves an empty one, so the path still ends in a slash
        return F.when(~part["dots"].isin(".", ".."), F.concat(done, F.array(part["x"]))).otherwise(
            F.when(part["last"], F.concat(base, F.array(F.lit("")))).otherwise(base))

    done = F.aggregate(marked, F.array().cast("array<string>"), step)
    has_dots = (path.contains("/.") | path.contains("/%2")) & path.rlike(_DOT_SEGMENT)
    return F.when(has_dots, F.concat(F.lit("/"), F.array_join(done, "/"))).otherwise(path)


def with_url_parts(df: DataFrame, src: Column | str, out: str, fields: list[str] | None = None) -> DataFrame:
    """Add struct column ``out`` with ``scheme, host, port, path, query, origin, valid``, or only those in ``fields``.

    Every part is null when the text is not a valid absolute URL (``valid``
    is then false).  One regular-expression match splits the text into its
    parts; the rest is plain string work, computed once per row in stages.
    """
    return with_many_url_parts(df, {out: src}, {out: fields} if fields else None)


def with_many_url_parts(df: DataFrame, sources: dict[str, Column | str],
                        fields: dict[str, list[str]] | None = None) -> DataFrame:
    """``with_url_parts`` for several columns at once (``{out: src}``), sharing
    each projection stage between them.  ``fields`` names the parts a caller
    reads, per ``out`` (default: all): the optimizer cannot leave out the others
    itself, as they pass through a generator."""
    stage: list[dict] = [{} for _ in range(6)]
    parts = {}
    tmp = set()
    default = F.create_map(*[x for k, v in DEFAULT_PORTS.items() for x in (F.lit(k), F.lit(v))])
    for out, src in sources.items():
        c = F.col(src) if isinstance(src, str) else src
        t = f"_{out}_"
        tmp |= {t + x for x in ("g0", "g", "s", "w", "hp", "p", "q", "sl", "rh", "pt", "ok", "h", "ep", "np")}
        trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
        # a text the pattern does not match comes back unchanged: one piece, not six
        stage[0][t + "g0"] = F.split(
            F.regexp_replace(trimmed, _MASTER_RE, _SEP.join(f"${i}" for i in range(1, 7))), _SEP)
        stage[1][t + "g"] = F.when(F.size(F.col(t + "g0")) == 6, F.col(t + "g0"))
        g = F.col(t + "g")
        s0 = F.lower(g[0])
        web = s0.isin(WEB_SCHEMES)
        slashes, auth, rest_path = g[1], g[2], g[3]
        # non-web schemes have an authority only after exactly "//"; else it all is path
        has_auth = web | (slashes == "//")
        stage[2].update({
            t + "s": s0,
            t + "w": web,
            t + "hp": F.when(has_auth, F.when(auth.contains("@"), F.regexp_replace(auth, r"^.*@", "")).otherwise(auth)).otherwise(F.lit("")),
            t + "p": F.when(has_auth, F.replace(rest_path, F.lit("\\"), F.lit("/"))).otherwise(
                F.concat(slashes, auth, rest_path)),
            t + "q": F.substring(g[4], 2, 1 << 30),
            t + "sl": has_auth & ~web,
        })
        s, w, hp = F.col(t + "s"), F.col(t + "w"), F.col(t + "hp")
        colon = F.instr(hp, ":")
        stage[3].update({
            t + "rh": F.when(colon > 0, F.substring_index(hp, ":", 1)).otherwise(hp),
            t + "pt": F.when(colon > 0, F.substring_index(hp, ":", -1)).otherwise(F.lit("")),
        })
        rh, pt = F.col(t + "rh"), F.col(t + "pt")
        web_ok = (rh != "") & ~rh.rlike(_BAD_HOST_RE) & ((pt == "") | pt.rlike(r"^[0-9]{1,5}$"))
        other_ok = ~rh.rlike(r"\s")
        stage[4].update({
            t + "ok": g.isNotNull() & F.when(w, web_ok).otherwise(other_ok),
            t + "h": F.when(w, F.lower(rh)).otherwise(rh),
            t + "ep": F.when(w, encode_path(F.col(t + "p"))).otherwise(F.col(t + "p")),
        })
        ep = F.col(t + "ep")
        stage[5][t + "np"] = F.when(w & ep.startswith("/"), remove_dots(ep)).otherwise(ep)
        ok, h = F.col(t + "ok"), F.col(t + "h")
        keep_port = (pt != "") & (pt != F.coalesce(default[s], F.lit("")))
        origin = F.when(
            w, F.concat(s, F.lit("://"), h, F.when(keep_port, F.concat(F.lit(":"), pt)).otherwise(F.lit("")))
        ).when(F.col(t + "sl"), F.concat(s, F.lit("://"), h)).otherwise(F.lit("null"))
        path = F.when(w & (F.col(t + "np") == ""), F.lit("/")).otherwise(F.col(t + "np"))
        every = {"scheme": s, "host": h, "port": pt, "path": path, "query": F.col(t + "q"), "origin": origin}
        wanted = (fields or {}).get(out, FIELDS)
        parts[out] = F.struct(*[(ok if f == "valid" else F.when(ok, every[f])).alias(f) for f in FIELDS if f in wanted])
    # one projection per dependency level (each withColumns is one analysis)
    for cols in stage:
        if cols:
            df = df.withColumns(cols)
    keep = [F.col(x) for x in df.columns if x not in tmp and x not in parts]
    # Emit the parts through a one-row generator: the optimizer cannot push a
    # filter on them below it, so a predicate such as "referer host allowed"
    # never gets the whole parse inlined (and duplicated) into it.
    gen = F.struct(*[p.alias(out) for out, p in parts.items()])
    return df.select(*keep, F.inline(F.array(gen)))


def origin_and_path(parts: Column) -> Column:
    """The URL with query and fragment removed (from a ``with_url_parts`` struct)."""
    return F.concat(parts["origin"], parts["path"])


def query_param(query: Column, key: str) -> Column:
    """First value of ``key`` in a query string, decoded (``+`` is a space); null if absent or empty."""
    q = F.concat(F.lit("&"), query)
    raw = F.regexp_extract(q, r"&" + key + r"=([^&]*)", 1)
    v = F.try_url_decode(raw)
    return F.when(q.rlike(r"&" + key + r"=") & (v != ""), v)


def host_of(df: DataFrame, src: Column | str, out: str) -> DataFrame:
    """Add column ``out``: the host of ``src`` (null when not a valid URL)."""
    tmp = f"_{out}_parts"
    return with_url_parts(df, src, tmp).withColumn(out, F.col(tmp)["host"]).drop(tmp)
