"""Near duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its five-word windows, each labelled with its occurrence number.  A sketch entry takes the three
k-mers of least hash under one hash function and keeps them in text order, so it is equal for two texts only if they
share the k-mers and their order.  Texts that share an entry are candidates: each is compared with the most central
text of the bucket, and those left apart with the others that share one of their rare k-mers (an exact prefix filter).  A candidate pair is linked if a
banded alignment of the words keeps at least 0.8 of the two texts' windows in place (kept / (all - kept)).
Equal texts are one node from the start, whatever their number.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WordCache, id_text, stored, texts_of
from tidemark.llm.components import components

#: Words of a k-mer, and the least similarity of a link.
K, SIMILARITY = 5, 0.8
#: Sketch entries and k-mers per entry: at similarity 0.8 an entry agrees with probability 0.8**3, so a pair is
#: missed with probability 0.488**16, one in a hundred thousand.
ENTRIES, PER_ENTRY = 16, 3
WORD = regex.compile(r"\w+")

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 63, ENTRIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, ENTRIES, dtype=np.uint64)
#: A hash is soon made again, so few are kept.
KEPT_HASHES = 200_000
_word_hash = WordCache(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")), KEPT_HASHES)


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(text: str) -> np.ndarray:
    """Hashes of the text's five-word windows, in order; a shorter text is one window, a text without words none."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - K + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(K, len(h))):
        out = _mix(out * np.uint64(31) + h[k:k + n])
    return out


def labelled(h: np.ndarray) -> np.ndarray:
    """Each k-mer's hash mixed with the number of equal ones before it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if not same.any():
        return h
    at = np.arange(len(h))
    first = np.maximum.accumulate(np.where(same, 0, at))
    nth = np.zeros(len(h), np.uint64)
    nth[order] = (at - first).astype(np.uint64)
    return np.where(nth > 0, _mix(h + nth * np.uint64(0x9E3779B97F4A7C15)), h)


def sketch(h: np.ndarray) -> np.ndarray:
    """The Order MinHash entries (as int64) of labelled k-mers."""
    if not h.size:
        return np.zeros(0, np.int64)
    x = h[None, :] * _MULTIPLY[:, None] + _ADD[:, None]
    x ^= x >> np.uint64(29)
    rows, picks = np.arange(ENTRIES), []
    for _ in range(min(PER_ENTRY, h.size)):
        at = x.argmin(axis=1)
        picks.append(at)
        x[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    entry = np.zeros(ENTRIES, np.uint64)
    for at in np.sort(np.array(picks), axis=0):
        entry = _mix(entry * np.uint64(31) + h[at])
    return entry.view(np.int64)


def matched_runs(a: list, b: list, limit: int) -> list[int] | None:
    """Lengths of the runs of equal words in a best alignment of ``a`` and ``b`` by insertions and deletions, or None
    if more than ``limit`` are needed.  Only diagonals within ``limit`` of the main one are visited (Myers' method)."""
    n, m = len(a), len(b)
    reach, trace = {1: 0}, []
    for d in range(limit + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                return _runs(trace, n, m)
    return None


def _runs(trace: list[dict], x: int, y: int) -> list[int]:
    runs = []
    for d in range(len(trace) - 1, -1, -1):
        reach, k = trace[d], x - y
        if d == 0:
            runs.append(x)
            break
        down = k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1))
        before = k + 1 if down else k - 1
        x0 = reach[before]
        start = x0 if down else x0 + 1
        runs.append(x - start)
        x, y = x0, x0 - before
    return runs


def similarity(a: list[str], b: list[str], least: float = SIMILARITY) -> float:
    """Share of the two texts' five-word windows that a banded alignment of their words keeps in place: kept / (all -
    kept).  0.0 as soon as it cannot reach ``least``.

    ``kept`` is at most the number of common windows, so those are counted first.  A similarity of ``least`` leaves at most
    (all windows) * (1 - least) / (1 + least) windows unmatched, and so as many words: the alignment's band.
    """
    if a == b:
        return 1.0
    na, nb = len(a) - K + 1, len(b) - K + 1
    if na < 1 or nb < 1:
        return 0.0
    if min(na, nb) < least * max(na, nb):
        return 0.0
    ga, gb = (Counter(zip(*(x[k:len(x) - K + 1 + k] for k in range(K)))) for x in (a, b))
    common = sum((ga & gb).values())
    if common < least * (na + nb - common):
        return 0.0
    runs = matched_runs(a, b, int((na + nb) * (1 - least) / (1 + least)) + 1)
    if runs is None:
        return 0.0
    kept = sum(max(0, r - K + 1) for r in runs)
    value = kept / (na + nb - kept)
    return value if value >= least else 0.0


def _sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n, entries`` of every row; ``key`` is the text's MD5, a null text's is its own."""
    def rows(batches):
        for batch in batches:
            hashes = [labelled(kmers(t)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([len(h) for h in hashes], pa.int32()),
                 pa.array([sketch(h) for h in hashes], pa.list_(pa.int64()))], ["doc_id", "key", "n", "entries"])

    return id_text(docs).withColumn("key", text_key()).mapInArrow(rows, "doc_id long, key binary, n int, entries array<long>")


def text_key() -> Column:
    own = F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.when(F.col("text").isNull(), F.encode(own, "UTF-8")).otherwise(F.unhex(F.md5(F.col("text").cast("binary"))))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``a, b``) whose texts are similar."""
    def check(batches):
        known: dict[bytes, list[str]] = {}

        def words(key, text):
            if key not in known:
                if len(known) > 64:
                    known.clear()
                known[key] = WORD.findall(text.lower())
            return known[key]

        for batch in batches:
            kept = [similarity(words(a, x), words(b, y)) > 0 for a, b, x, y in
                    zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")))]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    side = lambda c: texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a binary, b binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size, is_first, class_key``, one row per input row.

    ``class_id`` is the least ``doc_id`` among the documents that chains of links connect, or a negative hash of
    ``class_key`` if none of them has an id.  ``class_key`` names the class itself: classes that share a least ``doc_id``, as an id
    came with unrelated texts, differ in it.  ``is_first`` says that the row is the one to keep: the least ``doc_id`` of
    its class, and of several texts under that id the least key.  Equal texts share a class, empty ones too; a null text shares a class
    only with rows of its own ``doc_id``.  Texts without words link to equal texts only.  Rows that repeat an id
    and a text get the same answer.  Other columns are ignored; an empty table gives an empty result.
    """
    return _classes(docs).select("doc_id", "class_id", "class_size", "is_first", F.lower(F.hex("label")).alias("class_key"))


def _classes(docs: DataFrame) -> DataFrame:
    """``doc_id, key, label, class_id, class_size, is_first`` of every row; ``label`` is the class's least key."""
    rows = stored(_sketches(docs), "sketches")
    nodes = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                    F.first("n").alias("n"), F.first("entries").alias("entries"))
    nodes = stored(nodes, "nodes")
    buckets = nodes.select("key", F.posexplode("entries").alias("i", "e")).select("key", F.xxhash64("i", "e").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(buckets.join(shared, "bucket"), "members")
    # a bucket is led by its most central member: the one whose buckets are the fullest
    weight = members.groupBy("key").agg(F.sum("size").alias("weight"))
    leaders = (members.join(weight, "key").groupBy("bucket")
               .agg(F.max(F.struct("weight", "key")).alias("m")).select("bucket", F.col("m.key").alias("leader")))
    first = members.join(leaders, "bucket").where(F.col("key") != F.col("leader"))
    first = stored(first.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct(), "pairs")
    needed = members.select("key").distinct()
    reps = nodes.select(F.col("key").alias("rep_key"), "rep")
    texts = (id_text(docs).withColumn("key", text_key()).join(needed, "key")
             .join(reps, (F.col("key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep")))
             .select("key", "text").dropDuplicates(["key"]))
    texts = stored(texts, "texts")
    edges = stored(_linked(first, texts), "links")
    labels = components(edges)
    rest = stored(_rare_pairs(members, labels, nodes, texts).join(first, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        edges = stored(edges.union(_linked(rest, texts)), "links")
        labels = components(edges)
    classed = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", "copies", F.coalesce("label", "key").alias("label"))
    # the row to keep has the least id, if there is one, and of several texts under that id the least key
    sums = (classed.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "key")).alias("first"),
                                         F.sum("copies").alias("class_size")))
    own = F.lit(-1) - F.xxhash64("label").bitwiseAND(F.lit((1 << 63) - 1))
    answers = classed.join(sums, "label").select("key", "label", F.coalesce("first.rep", own).alias("class_id"), "class_size", "first")
    is_first = (F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.rep"))
    return rows.select("doc_id", "key").join(answers, "key").select("doc_id", "key", "label", "class_id", "class_size", is_first.alias("is_first"))


def _rare_pairs(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (``a, b``) of texts that share a bucket with another component and could still be similar.

    Exact prefix filter: in any order of k-mers that all texts share, two texts of similarity ``t`` have a k-mer in common
    among the first ``n - ceil(t * n) + 1`` of each.  The order is by frequency, rarest first: a text that differs from all
    others by words of its own meets nobody there, however many texts its bucket holds.
    """
    own = members.join(labels.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
    split = own.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    apart = own.join(split, "bucket").select("key", "label").distinct().join(nodes.select("key", "n"), "key")

    def rows(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                lists = [labelled(kmers(t)).view(np.int64) for t in texts_of(part)]
                at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(at) for c in ("key", "label", "n")] + [pa.array(np.concatenate(lists))], ["key", "label", "n", "kmer"])

    schema = "key binary, label binary, n int, kmer long"
    all_kmers = stored(texts.join(apart, "key").select("key", "label", "n", "text").mapInArrow(rows, schema), "kmers")
    often = all_kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("texts"), F.min("label").alias("low"), F.max("label").alias("high"))
    # all k-mers take part in the order, also those of one text or component, which no join needs
    order = Window.partitionBy("key").orderBy("texts", "kmer")
    ranked = all_kmers.join(often, "kmer").withColumn("nth", F.row_number().over(order))
    prefix = stored(ranked.where((F.col("nth") <= F.col("n") - F.ceil(F.col("n") * F.lit(SIMILARITY)) + 1) & (F.col("low") != F.col("high")))
                    .select("key", "label", "n", "kmer", (F.col("n") - F.col("nth")).alias("after")), "prefixes")
    x, y = prefix.alias("x"), prefix.alias("y")
    pairs = x.join(y, (F.col("x.kmer") == F.col("y.kmer")) & (F.col("x.label") < F.col("y.label"))
                   & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(SIMILARITY))
                   # behind the first common k-mer there must be room for all the others that the similarity asks for
                   & ((F.least("x.after", "y.after") + 1) * F.lit(1 + SIMILARITY) + F.lit(1e-6) >= (F.col("x.n") + F.col("y.n")) * F.lit(SIMILARITY)))
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: the one that ``near_duplicates`` marks as first (of rows that
    repeat its id and text, one)."""
    first = _classes(docs).where("is_first").select(F.col("doc_id").alias("__id"), F.col("key").alias("__first")).distinct()
    keyed = docs.withColumn("__key", text_key())
    kept = keyed.join(first, F.col("__id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__first") == F.col("__key")), "left_semi")
    return kept.dropDuplicates(["__key"]).drop("__key")
