"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame functions only.

Numbers that pass their own validation (card by Luhn, IBAN by its check digits, IPv4 by octet range,
social-security number by its ranges, phone by its form), dates that exist, e-mail addresses and secrets are
replaced by a value of the same format.  Each value is a list of digits of mixed radix; a Feistel network
with a keyed hash as round function permutes the values of a format, so equal values get equal pseudonyms
in every document and different values stay different.

Secrets are the providers' forms (AKIA/ASIA, gh?_, sk-) and what follows a key word (token, secret, api key, passwd, password; in
any case, quoted or not) and ``=`` or ``:`` with at most :data:`BLANKS` blanks on either side: a run of 8 or more letters,
digits and ``+/_-``, of any length and with its dotted parts.  IBANs stand together or in groups of four, cards in their
usual groups; a date may be followed by a time (``T10:00``).  Other wordings and forms stay in clear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import barrier, id_text, let

#: Key of the permutations; give your own.
DEFAULT_KEY = "tidemark-example-key"
ROUNDS = 8
#: Digits of half a value from which on the half's hash stands for it.
LONG = 64
#: Words that name a secret, and the blanks around the sign between word and secret (Java looks back over a bounded length).
KEY_WORDS, BLANKS = r"(?i:token|secret|api[_-]?key|passw(?:or)?d)", 8
_BLANKS = rf"[ \t]{{0,{BLANKS}}}"
#: What a provider's secret starts with.
PROVIDERS = ("AKIA", "ASIA", "gh[pousr]_", "sk-")
#: Rest of a run of unbounded length: possessive, so that no shorter part of a secret is ever taken.
_RUN = r"[A-Za-z0-9+/_-]"
_DOTTED = rf"(?:\.{_RUN}++)*+"
PROVIDER_SECRET = rf"(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36,}}+|sk-[A-Za-z0-9]{{20}}{_RUN}*+{_DOTTED}"
#: The two looks ahead and back in front only spare the long look back at most places.
KEYED_SECRET = (rf"(?={_RUN}{{8}})(?<=[=:]{_BLANKS}[\"']?)(?<={KEY_WORDS}[\"']?{_BLANKS}[=:]{_BLANKS}[\"']?)"
                rf"{_RUN}{{8,}}+{_DOTTED}")
#: Length of each country's IBANs: only it tells where one in groups ends.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}
GROUPED_IBAN = "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, c in IBAN_LENGTHS.items())
#: Java patterns by kind, in order of precedence; each needs an edge on both sides.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}",
    "secret": f"{PROVIDER_SECRET}|{KEYED_SECRET}",
    "iban": f"{GROUPED_IBAN}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{2,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}"
             r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
    "card": r"[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19}",
}
#: No letter, digit or joined number may stand next to a value.
EDGES = (r"(?<![A-Za-z0-9])(?<![0-9][.-])", r"(?![A-Za-z0-9])(?![.-][0-9])")
#: A time may follow a date.
RIGHT_EDGES = {"date": f"(?:{EDGES[1]}|(?=[Tt][0-9]{{2}}))"}
#: Every value holds one of these: digits, the sign of an address, or how a secret starts.
ANY_SIGN = f"[0-9@]|{'|'.join(PROVIDERS)}|{KEY_WORDS}"
#: Dates from 1900-01-01 on: 200 years are 73,049 days.  The product of these radices is two more; see ``_date``.
DAYS = 73_049
DATE_RADICES = (319, 229)
DATE_FORMATS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{4}/": "yyyy/MM/dd", r"^\d\d\.": "dd.MM.yyyy", r"^\d\d/": "MM/dd/yyyy"}
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def any_value() -> str:
    return EDGES[0] + "(?:" + "|".join(f"(?:{p}){RIGHT_EDGES.get(k, EDGES[1])}" for k, p in PATTERNS.items()) + ")"


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != F.lit(""))


def feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    """Permute lists of ints, the i-th below the i-th radix.  Rounds alternate: each adds, digit by digit, a
    keyed hash of one half to the other half, which the other half's owner can subtract again."""
    return let(F.struct(values.alias("v"), radices.alias("r")), lambda x: _feistel(x["v"], x["r"], key, kind))


def _feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    half = F.floor(F.size(values) / F.lit(2)).cast("int")
    rest = F.size(values) - half

    def moved(part: Column, first: Column, other: Column, r: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        # a long half is hashed once, so the work grows with a value's length, not with its square
        seed = F.when(F.size(other) > LONG, F.sha2(seed.cast("binary"), 256)).otherwise(seed)
        return let(seed, lambda q: F.transform(part, lambda x, i: F.pmod(
            x + F.conv(F.substring(F.sha2(F.concat_ws("|", q, i.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long"),
            F.get(radices, i + first)).cast("long")))

    start = F.struct(F.slice(values, F.lit(1), half).alias("a"), F.slice(values, half + 1, rest).alias("b"))

    def step(s: Column, r: Column) -> Column:
        return (F.when(r % 2 == 0, F.struct(s["a"].alias("a"), moved(s["b"], half, s["a"], r).alias("b")))
                .otherwise(F.struct(moved(s["a"], F.lit(0), s["b"], r).alias("a"), s["b"].alias("b"))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def _alphabet(c: Column) -> Column:
    return (F.when(c.between("0", "9"), F.lit(DIGITS)).when(c.between("A", "Z"), F.lit(UPPER))
            .when(c.between("a", "z"), F.lit(LOWER)))


def _value(c: Column) -> Column:
    code = F.ascii(c)
    return (F.when(code < 58, code - 48).when(code < 91, code - 65).otherwise(code - 97)).cast("long")


def _letter(c: Column, v: Column) -> Column:
    """The character of value ``v`` in the class of ``c``."""
    return F.substring(_alphabet(c), v.cast("int") + 1, F.lit(1))


def permuted_text(s: Column, key: str, kind: str) -> Column:
    """Letters and digits of ``s`` permuted within their class and place; all else stays."""
    return let(_chars(s), lambda chars: _permuted(chars, key, kind))


def _permuted(chars: Column, key: str, kind: str) -> Column:
    # fixed characters take part as the only value of radix 1
    radices = F.transform(chars, lambda c: F.coalesce(F.length(_alphabet(c)), F.lit(1)).cast("long"))
    values = F.transform(chars, lambda c: F.when(_alphabet(c).isNotNull(), _value(c)).otherwise(F.lit(0)).cast("long"))
    new = feistel(values, radices, key, kind)
    return F.array_join(F.zip_with(chars, new, lambda c, v: F.coalesce(_letter(c, v), c)), "")


def _digit_sum(digits: Column) -> Column:
    """Luhn sum, the last digit counted once, the one before it doubled, and so on."""
    n = F.size(digits)
    return F.aggregate(F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)),
                       F.lit(0).cast("long"), lambda a, d: a + d)


def _digits(s: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("long"))


def _refilled(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced in order."""
    step = lambda a, c: F.when(
        c.between("0", "9"), F.struct(F.concat(a["o"], F.get(digits, a["n"]).cast("string")).alias("o"), (a["n"] + 1).alias("n"))
    ).otherwise(F.struct(F.concat(a["o"], c).alias("o"), a["n"].alias("n")))
    return F.aggregate(_chars(s), F.struct(F.lit("").alias("o"), F.lit(0).alias("n")), step, lambda a: a["o"])


def _card(s: Column, key: str) -> Column:
    """All digits but the check digit are permuted, then the check digit is set: valid cards to valid cards."""
    digits = _digits(s)
    body = F.slice(digits, F.lit(1), F.size(digits) - 1)
    new = feistel(body, F.transform(body, lambda _: F.lit(10).cast("long")), key, "card")
    check = lambda b: F.pmod(F.lit(10) - F.pmod(_digit_sum(F.concat(b, F.array(F.lit(0).cast("long")))), F.lit(10)), F.lit(10))
    filled = let(new, lambda b: let(F.concat(b, F.array(check(b).cast("long"))), lambda d: _refilled(s, d)))
    return F.when(F.pmod(_digit_sum(digits), F.lit(10)) == 0, filled)


def _mod97(s: Column) -> Column:
    """The number of an IBAN whose first four characters stand last, modulo 97."""
    turned = F.concat(F.substring(s, F.lit(5), F.length(s) - 4), F.substring(s, 1, 4))
    return F.aggregate(_chars(turned), F.lit(0).cast("long"), lambda a, c: F.when(
        c.between("0", "9"), F.pmod(a * 10 + _value(c), F.lit(97))).otherwise(F.pmod(a * 100 + _value(c) + 10, F.lit(97))).cast("long"))


def _iban(s: Column, key: str) -> Column:
    """Together or in groups of four; the same number gets the same pseudonym either way."""
    return let(F.struct(F.replace(s, F.lit(" "), F.lit("")).alias("s"), F.contains(s, F.lit(" ")).alias("g")),
               lambda x: _whole_iban(x["s"], x["g"], key))


def _whole_iban(s: Column, grouped: Column, key: str) -> Column:
    country = F.substring(s, 1, 2)
    check = lambda body: F.lit(98) - _mod97(F.concat(country, F.lit("00"), body))
    new = F.when(_mod97(s) == 1, let(permuted_text(F.substring(s, F.lit(5), F.length(s) - 4), key, "iban"), lambda body: F.concat(
        country, F.lpad(check(body).cast("string"), 2, "0"), body)))
    # every group of four has its blank again
    return F.when(grouped, F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)


def _ip(s: Column, key: str) -> Column:
    octets = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    new = feistel(octets, F.transform(octets, lambda _: F.lit(256).cast("long")), key, "ip")
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(F.transform(new, lambda x: x.cast("string")), "."))


def _ssn(s: Column, key: str) -> Column:
    """Areas 001-665 and 667-899, groups 01-99 and serials 0001-9999 exist."""
    parts = F.transform(F.split(s, "-"), lambda x: x.cast("long"))
    area, group, serial = (F.get(parts, F.lit(i)) for i in range(3))
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    new = feistel(values, F.array(*[F.lit(r).cast("long") for r in (898, 99, 9999)]), key, "ssn")
    text = let(new, lambda x: let(F.get(x, F.lit(0)), lambda a: F.concat_ws(
        "-", F.lpad(F.when(a > 664, a + 2).otherwise(a + 1).cast("string"), 3, "0"),
        F.lpad((F.get(x, F.lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(x, F.lit(2)) + 1).cast("string"), 4, "0"))))
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), text)


def _date(s: Column, key: str) -> Column:
    """A date from 1900 to 2099 that exists, in one of the formats; ``xx/yy/zzzz`` is month first, else day first."""
    def moved(day: Column, pattern: str) -> Column:
        """The permuted day in the same format; null if there is no such day."""
        def permuted(d: Column) -> Column:
            new = feistel(F.array(F.floor(d / F.lit(DATE_RADICES[1])).cast("long"), F.pmod(d, F.lit(DATE_RADICES[1])).cast("long")),
                          F.array(*[F.lit(r).cast("long") for r in DATE_RADICES]), key, "date")
            return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a * DATE_RADICES[1] + x)

        # cycle walking: permute again what falls on the numbers beyond the last day, as many times as there are such numbers
        spare = DATE_RADICES[0] * DATE_RADICES[1] - DAYS
        index = F.aggregate(F.sequence(F.lit(0), F.lit(spare)), day, lambda d, k: F.when((k == 0) | (d >= DAYS), permuted(d)).otherwise(d))
        return F.when(day.between(0, DAYS - 1), F.date_format(
            F.date_add(F.lit("1900-01-01").cast("date"), index.cast("int")), pattern))

    forms = [*DATE_FORMATS.items(), (r"^\d\d/", "dd/MM/yyyy")]
    def of(pattern: str) -> Column:
        return let(F.datediff(F.try_to_date(s, pattern), F.lit("1900-01-01").cast("date")).cast("long"), lambda day: moved(day, pattern))

    return F.coalesce(*[F.when(F.rlike(s, F.lit(form)), of(pattern)) for form, pattern in forms])


def _email(s: Column, key: str) -> Column:
    return F.concat(permuted_text(F.substring_index(s, "@", 1), key, "email"), F.lit("@"), F.substring_index(s, "@", -1))


def _secret(s: Column, key: str) -> Column:
    """A provider's prefix stays, the rest is permuted."""
    prefix = F.regexp_extract(s, r"^(?:AKIA|ASIA|gh[pousr]_|sk-)", 0)
    return F.concat(prefix, permuted_text(F.substring(s, F.length(prefix) + 1, F.length(s)), key, "secret"))


def _phone(s: Column, key: str) -> Column:
    """The country code stays, the other digits are permuted."""
    prefix = F.regexp_extract(s, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    return F.concat(prefix, permuted_text(F.substring(s, F.length(prefix) + 1, F.length(s)), key, "phone"))


REPLACERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """Struct ``kind, new`` of a found value: the first kind of its form that validates; both null if none does."""
    others = "^(?:" + "|".join(p for k, p in PATTERNS.items() if k != "secret") + ")$"
    kinds = []
    for kind, pattern in PATTERNS.items():
        bare = PROVIDER_SECRET if kind == "secret" else pattern
        form = F.rlike(value, F.lit(f"^(?:{bare})$"))
        if kind == "secret":  # what follows a key word has no form of its own: it is a secret if nothing else
            form = form | ~F.rlike(value, F.lit(others))
        new = F.when(form, REPLACERS[kind](value, key))
        if kind == "card":  # groups that look like an IBAN and are none may hold a card
            target = F.when(form, value).otherwise(F.when(F.rlike(value, F.lit(f"^(?:{GROUPED_IBAN})$")), F.nullif(
                F.regexp_extract(value, EDGES[0] + "[0-9]{4}(?: [0-9]{4}){3}" + EDGES[1], 0), F.lit(""))))
            new = let(target, lambda t: F.replace(value, t, _card(t, key)))
        kinds.append(F.struct(F.lit(kind).alias("kind"), new.alias("new")))
    return F.get(F.filter(F.array(*kinds), lambda x: x["new"].isNotNull()), F.lit(0))


def _with_found(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``__gaps`` (the text between values) and ``__new`` (per value: struct kind, new, old)."""
    pattern = F.lit(any_value())
    has = F.rlike("text", F.lit(ANY_SIGN)) & F.rlike("text", pattern)
    df = docs.select("*", F.when(has, F.regexp_extract_all("text", pattern, F.lit(0))).alias("__old"),
                     F.when(has, F.split("text", any_value(), -1)).alias("__gaps"))
    return barrier(df.select("*", F.transform("__old", lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("p"))).alias("__new")))


def _joined() -> Column:
    """The text with its values replaced."""
    values = F.transform("__new", lambda x: F.coalesce(x["p"]["new"], x["old"]))
    return F.when(F.col("__gaps").isNull(), F.col("text")).otherwise(
        F.array_join(F.zip_with("__gaps", values, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), ""))


def pseudonymize(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; other columns stay (``n_chars``, if there is one, is the new length)."""
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    df = _with_found(docs, key).select(*[F.col(f"`{c}`") for c in docs.columns], _joined().alias("__text"))
    out["text"] = F.col("__text")
    if "n_chars" in out:
        out["n_chars"] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    return df.select(*[v.alias(c) for c, v in out.items()])


def pii_report(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """``doc_id, text, n_values, kinds`` of every document: the text with pseudonyms, how many values were
    replaced, and their kinds, sorted.

    Null text stays null with no values; repeated rows are treated each, alike; other columns are ignored;
    an empty table gives an empty result.  One projection: no row moves.
    """
    df = _with_found(id_text(docs), key)
    found = F.filter(F.coalesce("__new", F.array().cast("array<struct<old:string,p:struct<kind:string,new:string>>>")),
                     lambda x: x["p"].isNotNull())
    return df.select("doc_id", _joined().alias("text"), F.size(found).cast("long").alias("n_values"),
                     F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["p"]["kind"]))), ",").alias("kinds"))
