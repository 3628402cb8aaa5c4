"""Spelling variants: words one edit apart, found through an index of grams of variable length.

1. *Gram dictionary.*  Grams of :data:`Q_MIN` to :data:`Q_MAX` code points are counted over all words.  A shortest gram
   always belongs to the dictionary; a longer one only if the gram it prolongs is frequent (in at least
   :data:`FREQUENT_SHARE` of the words' number), so rare grams keep their short, shared form.  The dictionary goes out to
   the tasks: frequent grams number at most (mean word length / share), each with one entry per letter of the alphabet.
2. *Decomposition.*  A word's grams are, place by place, the longest dictionary gram that begins there, without those
   that lie inside an earlier one.
3. *Affected grams.*  For each place of an edit, :func:`most_affected` counts the grams that the edit may change: those
   that hold it, those before it that a longer gram could swallow (the letters up to the edit begin a dictionary gram)
   and those after it (the letters from the edit end one).  All other grams are in both words, at the same distance from
   their start or end.  With words of at least ``2 * Q_MAX`` letters an edit always leaves one gram unaffected.
4. *List merging.*  Two near words share all but ``affected`` grams of each, so they share one of the ``affected + 1``
   rarest grams of each; only these are listed, under (gram, place, word length), and looked up from the words of equal
   or one less length.  The lists of a word's frequent grams are never merged.
5. *Verification.*  Each merged pair is compared by edit distance inside the join, so only near words leave it.

Defined cases.  A null text has no words; a null doc_id counts as an empty one; repeated rows count again; an empty table
gives no rows; other columns are ignored.  Words of any length are taken whole.  Equal counts: the form is the near word
smallest in code-point order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

Q_MIN = 2
Q_MAX = 3
FREQUENT_SHARE = 0.01
#: A form stands for a word if it is at least this many times as frequent.
RATIO = 5

#: What a word is, and which runs lose a letter.
RUN = "([A-Za-zÀ-ÿ]+)"
MIN_LENGTH = 6
MIN_COUNT = 5
LOSES = 199
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words with at least :data:`MIN_LENGTH` letters and :data:`MIN_COUNT` occurrences."""
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(ids.alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(1))).alias("run"))
    runs = runs.where(F.length("run") >= MIN_LENGTH).withColumn("run", F.translate("run", UPPER, UPPER.lower()))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % LOSES == 0, F.overlay("run", F.lit(""), at + 1, F.lit(1))).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT))


def gram_dictionary(words: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX, share: float = FREQUENT_SHARE) -> dict[str, int]:
    """Gram -> how often it begins somewhere in ``words``, for the grams kept (see 1. above)."""
    frequent = share * words.count()

    def grams(q):
        return F.transform(F.sequence(F.lit(1), F.length("word") - q + 1), lambda i: F.substring(F.col("word"), i, F.lit(q)))

    kept, level = {}, None
    for q in range(q_min, q_max + 1):
        level = list(kept) if q > q_min else None
        counts = (words.where(F.length("word") >= q).select(F.explode(grams(q)).alias("gram"))
                  .groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
        if level is not None:
            long_enough = [g for g in level if len(g) == q - 1 and kept[g] >= frequent]
            parents = words.sparkSession.createDataFrame([(g,) for g in long_enough], "parent string")
            counts = counts.join(F.broadcast(parents), F.substring("gram", 1, q - 1) == F.col("parent"), "left_semi")
        kept.update((r["gram"], r["n"]) for r in counts.toLocalIterator())
    return kept


class Decomposer:
    """Variable grams of a word by a fixed dictionary, and how many of them an edit may affect."""

    def __init__(self, dictionary, q_min: int = Q_MIN, q_max: int = Q_MAX):
        self.q_min, self.q_max = q_min, q_max
        self.grams = frozenset(dictionary)
        # proper beginnings and ends of dictionary grams, for what a new gram across an edit could swallow
        self.begins = frozenset(g[:k] for g in self.grams for k in range(1, len(g)))
        self.ends = frozenset(g[k:] for g in self.grams for k in range(1, len(g)))

    def decompose(self, word: str) -> list[tuple[int, str]]:
        out, reach = [], 0
        for p in range(len(word) - self.q_min + 1):
            q = next((q for q in range(min(self.q_max, len(word) - p), self.q_min, -1) if word[p:p + q] in self.grams), self.q_min)
            if p + q > reach:
                out.append((p, word[p:p + q]))
                reach = p + q
        return out

    def _reach(self, word: str, left: int, right: int) -> tuple[int, int]:
        """For an edit of the letters between ``left`` and ``right`` (both unchanged outside): the leftmost start of a
        new gram across the edit, and the rightmost end of one."""
        first = next((j for j in range(max(0, left - self.q_max + 1), left) if word[j:left] in self.begins), left)
        last = next((f for f in range(min(len(word), right + self.q_max - 1), right, -1) if word[right:f] in self.ends), right)
        return first, last

    def most_affected(self, word: str, grams: list[tuple[int, str]]) -> int:
        """The most grams that one inserted, deleted or replaced letter can affect, over all places."""
        most, low = 0, 0
        for left in range(len(word) + 1):
            while low < len(grams) and grams[low][0] < left - 2 * self.q_max:
                low += 1
            for right in (left, left + 1):  # a letter put in at ``left``, or the letter at ``left`` replaced or removed
                if right > len(word):
                    continue
                first, last = self._reach(word, left, right)
                n = 0
                for p, g in grams[low:]:
                    if p > left + self.q_max:
                        break
                    end = p + len(g)
                    before, after = end <= left, p >= right
                    n += (p >= first) if before else (end <= last) if after else True
                most = max(most, n)
        return most


def listed_grams(words: DataFrame, dictionary: dict[str, int], q_min: int = Q_MIN, q_max: int = Q_MAX) -> DataFrame:
    """``word, n, gram, place, size``: each word's ``affected + 1`` rarest grams."""
    shared = words.sparkSession.sparkContext.broadcast(dictionary)

    def rows(batches):
        counts = shared.value
        made = Decomposer(counts, q_min, q_max)
        for batch in batches:
            out = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                grams = made.decompose(word)
                keep = made.most_affected(word, grams) + 1
                grams.sort(key=lambda x: (counts.get(x[1], 0), x[1], x[0]))
                out += [(word, n, g, p, len(word)) for p, g in grams[:keep]]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()))],
                    names=["word", "n", "gram", "place", "size"])

    return words.select("word", "n").mapInArrow(rows, "word string, n long, gram string, place int, size int")


def near_words(words: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX, share: float = FREQUENT_SHARE) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of distinct words (all of at least ``2 * q_max`` letters) exactly one edit apart, once.

    ``words`` (``word, n``) should be a stored table, as it is read several times.
    """
    lists = stored(listed_grams(words, gram_dictionary(words, q_min, q_max, share), q_min, q_max), "grams")
    # the other word is as long, or one letter longer: a shared gram then stands at the same place or one further on
    places = F.explode(F.array(F.struct(F.col("place").alias("place"), F.col("size").alias("size")),
                               F.struct(F.col("place").alias("place"), (F.col("size") + 1).alias("size")),
                               F.struct((F.col("place") + 1).alias("place"), (F.col("size") + 1).alias("size"))))
    probes = lists.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "gram", places.alias("x")).select(
        "a", "n_a", F.col("gram").alias("g"), F.col("x.place").alias("p"), F.col("x.size").alias("z"))
    other = lists.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "gram", "place", "size")
    same = (F.col("g") == F.col("gram")) & (F.col("p") == F.col("place")) & (F.col("z") == F.col("size"))
    once = (F.length("a") < F.col("size")) | (F.col("a") < F.col("b"))
    return probes.join(other, same & once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms (``word, form``) lead.  A form is more frequent than its word, so chains end;
    each round doubles the steps taken."""
    spark_forms = stored(forms.select("word", "form"), "forms")
    at = spark_forms.withColumnRenamed("form", "root")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_groups(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table of words and counts."""
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select(F.col("b"), F.col("n_b"), F.col("a"), F.col("n_a")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("near"))).alias("best"))
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"),
        (-F.col("best.rank")).alias("near_n"))
    fits = F.col("near_n") >= RATIO * F.col("n")
    formed = stored(found.select("word", F.when(fits, F.col("near")).alias("form"), "n", "n_near",
                                 F.when(fits, F.col("near_n")).alias("form_n")), "formed")
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """:func:`spelling_groups` of the words of ``docs`` (``doc_id, text``)."""
    return spelling_groups(vocabulary(docs))
