"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate), failing lines are removed, and a
document that loses too much of its text is rejected.  The base counts (words, symbols, repeated
lines and windows) are taken of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import barrier, id_text, let

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5
MIN_WORDS = 10
#: Percent of the words that may lie in repeated windows.
MAX_REPEAT_PERCENT = 20
#: A document that keeps less than this share of its non-blank characters is rejected.
MIN_KEPT_SHARE = 0.6

#: A line fails on punctuation if more than this share of its words end in two or more marks or
#: symbols, or if it has no lower-case letter but so many upper-case ones.
MAX_MARKED_SHARE = 0.3
MARKS = r"[!?#*$%&|<>~^=_@+]{2}"
MARKED_END = r"[!?#*$%&|<>~^=_@+]{2}[.,;:]?$"
SHOUT_LETTERS = 20
#: A line fails as navigation if separators are more than this share of its words.
MAX_SEPARATOR_SHARE = 0.2
SEPARATORS = ("|", "||", "»", "›", "•", "·", "→", "::", ">", ">>")
#: Boilerplate of web pages: a short line that holds one of these fails.
BOILERPLATE = (r"(?i)\b(?:lorem ipsum|all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|"
               r"accept (?:all )?cookies|enable javascript|click here|read more|sign (?:in|up)|log ?in|"
               r"subscribe to our newsletter|skip to content|share on (?:facebook|twitter)|back to top|"
               r"page not found|add to cart)\b")
BOILERPLATE_WORDS = 25


def words_of(text: Column) -> Column:
    # a leading gap gives one empty first element, an empty or blank text one empty element
    return F.filter(F.split(text, GAP), lambda w: w != F.lit(""))


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule.  Blank lines never fail.  The cheap test of each rule comes first."""
    share = lambda test: let(words_of(line), lambda ws: F.size(F.filter(ws, test)) / F.size(ws))
    marked = F.rlike(line, F.lit(MARKS)) & (share(lambda w: F.rlike(w, F.lit(MARKED_END))) > MAX_MARKED_SHARE)
    shout = ~F.rlike(line, F.lit(r"\p{Ll}")) & (F.regexp_count(line, F.lit(r"\p{Lu}")) >= SHOUT_LETTERS)
    navigation = F.rlike(line, F.lit(r"[|»›•·→:>]")) & (share(lambda w: w.isin(*SEPARATORS)) > MAX_SEPARATOR_SHARE)
    boilerplate = F.rlike(line, F.lit(BOILERPLATE)) & (F.size(words_of(line)) <= BOILERPLATE_WORDS)
    return F.rlike(line, F.lit(WORD)) & (marked | shout | navigation | boilerplate)


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words covered by a window whose text occurs twice or more; ``hashes`` are the windows' in order.

    The windows are sorted by hash; those with an equal neighbour are the repeated ones.  In text order, a
    repeated window adds its width or the distance to the next one, whichever is less.
    """
    def places(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(pairs, a)["h"] == F.get(pairs, b)["h"], F.lit(False))
        return F.array_sort(F.transform(
            F.filter(F.transform(pairs, lambda p, k: F.struct(p["i"].alias("i"), (same(k, k - 1) | same(k, k + 1)).alias("twice"))),
                     lambda p: p["twice"]), lambda p: p["i"]))

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    cover = F.aggregate(
        let(pairs, places), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda s, p: F.struct(p.alias("last"), (s["sum"] + F.least(F.lit(WINDOW), p - s["last"])).alias("sum")),
        lambda s: s["sum"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(cover)


def _judged(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``q`` (a struct of base counts) and ``kept_lines``; ``text`` must be a string."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # each step is a column of its own: a later one refers to it instead of computing it again
    df = docs.select("*", text.alias("__t")).select("*", words_of(F.col("__t")).alias("__w"), F.split("__t", "\n").alias("__l"))
    n = F.size("__w")
    at = lambda i, k: F.get(F.col("__w"), i + k)
    windows = F.when(n >= WINDOW + 1, F.transform(F.sequence(F.lit(0), n - WINDOW),
                                                  lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    lines = F.filter("__l", lambda x: F.rlike(x, F.lit(WORD)))
    return df.select("*", windows.alias("__h"), lines.alias("__wl"))


def quality(docs: DataFrame) -> DataFrame:
    """Base counts and verdict of every whole text, one row per input row:
    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_share``.

    Null text counts as empty: no words, so it fails the base rule.  Repeated rows are judged each;
    other columns are ignored; an empty table gives an empty result.  No row moves: one projection.
    """
    df = _judged(id_text(docs))
    solid = lambda c: F.length(F.regexp_replace(c, GAP, ""))
    chars = F.length(F.array_join("__w", ""))
    lost = F.aggregate(F.filter("__wl", line_fails), F.lit(0), lambda s, x: s + solid(x))
    df = df.select(
        "doc_id", F.size("__w").cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__wl") - F.size(F.array_distinct("__wl"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated_words(F.col("__w"), F.col("__h")), F.lit(0)).cast("long").alias("n_repeat_words"),
        lost.alias("__lost"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    share = F.when(F.col("word_chars") == 0, F.lit(0.0)).otherwise(
        (F.col("word_chars") - F.col("__lost")).cast("double") / F.col("word_chars"))
    return (barrier(df.select("*", failed.alias("base_failed"), share.alias("kept_share")))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("kept_share") >= MIN_KEPT_SHARE)).alias("kept"), "kept_share"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, all their columns, ``text`` without its failing lines.

    ``n_chars``, if there is one, is set to the new text's length.  A row's verdict is that of :func:`quality`.
    """
    columns = docs.columns
    df = _judged(docs)
    # a pass of the lines through the rules: their positions decide what stays
    df = df.select("*", F.filter("__l", lambda x: ~line_fails(x)).alias("__k"))
    df = df.select("*", F.array_join("__k", "\n").alias("__new"),
                   F.coalesce(repeated_words(F.col("__w"), F.col("__h")), F.lit(0)).alias("__r"))
    n = F.size("__w")
    passes = (n >= MIN_WORDS) & (F.lit(100) * F.col("__r") <= F.lit(MAX_REPEAT_PERCENT) * n) & (
        F.length(F.regexp_replace("__new", GAP, "")).cast("double") / F.length(F.array_join("__w", "")) >= MIN_KEPT_SHARE)
    out = {c: F.col(f"`{c}`") for c in columns}
    out["text"] = F.col("__new")
    if "n_chars" in out:
        out["n_chars"] = F.length("__new").cast(docs.schema["n_chars"].dataType)
    return barrier(df).where(passes).select(*[v.alias(c) for c, v in out.items()])
