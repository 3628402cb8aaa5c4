"""New letters in both token operators, hot ids in token files, the keyed permutation against a plain one."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F
from tidemark.llm import pii, token_count, wavelet
from tidemark.llm.common import tokenizer_path

#: Letters newer than this Python's Unicode tables, alone, in words, beside capitals, marks and blanks.
NEW = ["x\ua7cby", "\u1c89", "a \U00010d50b c", "\ua7cb\ua7dc!! É\ua7cb", "Ab\u0301\ua7cb c\u0301", "\u1c89\u1c8a 12 \u0378x don't", "😀\ua7cb\t\ua7cb\n"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_new_letters_as_the_library_has_them(spark):
    rng = random.Random(4)
    pool = "aB é\u0301\ua7cb\u1c89\u0378\U00010d50ß'S1½ \n!"
    texts = NEW + ["".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(300)] + ["\ua7cb" * 5000 + " plain words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [library().encode(t, add_special_tokens=False).ids for t in texts]
    counts = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(df).collect()}
    assert [counts[i] for i in range(len(texts))] == [len(x) for x in want]
    encoder = wavelet.Encoder(tokenizer_path("word_bpe_49k.json"))
    assert [list(memoryview(b).cast("I")) for b in encoder.encode(texts)] == want


def test_hot_id_and_hot_row_are_split(spark):
    rows = [(None, "same text")] * 300 + [(None, f"text {i}") for i in range(300)] + [(7, f"more {i}") for i in range(300)] + [(i, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = wavelet.token_files(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(out) == len(rows) and len({r["shard_part"] for r in out if r["doc_id"] is None}) > 2
    at = sorted(out, key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in itertools.pairwise(at))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in at]
    assert ids == sorted(ids)


def plain_feistel(values, radices, key, kind):
    half = len(values) // 2
    for r in range(pii.ROUNDS):
        a, b = values[:half], values[half:]
        part, first, other = (b, half, a) if r % 2 == 0 else (a, 0, b)
        seed = f"{key}|{kind}|{r}|" + ",".join(map(str, other))
        if len(other) > pii.LONG:
            seed = hashlib.sha256(seed.encode()).hexdigest()
        part = [(x + int(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()[:8], 16)) % radices[i + first] for i, x in enumerate(part)]
        values = a + part if r % 2 == 0 else part + b
    return values


def test_feistel_equals_a_plain_one_and_is_a_permutation(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        radices = [rng.choice([2, 9, 10, 26, 36, 898]) for _ in range(rng.choice([1, 2, 3, 9, 16, 70]))]
        rows.append((i, [rng.randrange(r) for r in radices], radices))
    df = spark.createDataFrame(rows, "i int, v array<long>, r array<long>")
    got = {r["i"]: r["x"] for r in df.select("i", pii.feistel(F.col("v"), F.col("r"), "k", "card").alias("x")).collect()}
    assert all(got[i] == plain_feistel(v, r, "k", "card") for i, v, r in rows)
    grid = spark.createDataFrame([([a, b, c], [5, 7, 3]) for a in range(5) for b in range(7) for c in range(3)], "v array<long>, r array<long>")
    assert grid.select(pii.feistel(F.col("v"), F.col("r"), "k", "x").alias("x")).distinct().count() == 105


def test_dates_are_permuted_within_their_years(spark):
    days = spark.range(pii.DAYS).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    out = days.select("d", pii._date(F.col("d"), "k").alias("x"))
    low, high, n, known = out.agg(F.min("x"), F.max("x"), F.count_distinct("x"), F.count("x")).first()
    assert (low, high, n, known) == ("1900-01-01", "2099-12-31", pii.DAYS, pii.DAYS)
    outside = spark.createDataFrame([("1899-12-31",), ("2100-01-01",), ("2100-01-02",), ("2099-02-30",)], "d string")
    assert [r[0] for r in outside.select(pii._date(F.col("d"), "k")).collect()] == [None] * 4
