"""Decontamination against aligning every item with every whole document, and on odd input."""

import random

import numpy as np
import pytest

from tidemark.llm import decontam


def brute(texts, items):
    """(document, item, score) of all pairs whose whole alignment reaches the least score."""
    out = set()
    for i, item in enumerate(items):
        words = decontam.WORD.findall(item.lower())
        for d, text in enumerate(texts):
            there = decontam.WORD.findall(text.lower())
            if len(words) < decontam.MIN_WORDS:
                if words and there == words:
                    out.add((d, i, 1.0))
                continue
            number = {w: k for k, w in enumerate(words, 1)}
            row = np.array([[number.get(w, 0) for w in there] or [0]])
            score = decontam.smith_waterman(np.array([number[w] for w in words]), row)[0][0]
            if score >= max(len(words), 6):
                out.add((d, i, score / (2 * len(words))))
    return out


def changed(words, rng, kind, vocabulary):
    """A copy with every so many words replaced, put in, or left out, or with all of these at random."""
    if kind == "third":
        return [w if k % 3 else "new%d" % rng.randrange(10**6) for k, w in enumerate(words)]
    if kind == "inserted":
        return [x for k, w in enumerate(words) for x in ([w, "new%d" % rng.randrange(10**6)] if k % 2 else [w])]
    if kind == "between":
        return [x for w in words for x in (w, rng.choice(vocabulary))][:-1]
    if kind == "left out":
        return [w for k, w in enumerate(words) if k % 4]
    share, out = rng.uniform(0, 0.35), []
    for w in words:
        if rng.random() >= share:
            out.append(w)
        elif rng.random() < 0.67:
            out += [rng.choice(vocabulary)] if rng.random() < 0.5 else [w, rng.choice(vocabulary)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_every_alignment_is_found(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(150)]  # few words: seeds are common, chance pairs too
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 60))) for _ in range(40)] + ["one two", "solo", "", "!!"]
    texts = ["", "solo", "One, two!", "one two three", "v1 v2"]
    for k in range(160):
        words = rng.choices(vocabulary, k=rng.randint(0, 150))
        copy = items[rng.randrange(40)].split()
        words[len(words) // 2:len(words) // 2] = changed(copy, rng, ("third", "inserted", "between", "left out", "mixed", "mixed")[k % 6], vocabulary)
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute(texts, items)
    rows = decontam.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:  # the place holds the copy
        words = decontam.WORD.findall(texts[r["doc_id"]].lower())[r["first_word"]:r["last_word"] + 1]
        assert (0, 0, r["score"]) in brute([" ".join(words)], [items[r["item_id"]]])


def test_copies_without_three_whole_words(spark):
    rng = random.Random(5)
    items = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(100)]
    for kind, score in (("third", 0.5), ("inserted", 0.75), ("between", 0.5)):
        noise = [f"n{k}" for k in range(50)]
        texts = [" ".join(noise + changed(x.split() if kind != "third" else [*x.split(), ""][:30], rng, kind, noise) + noise) for x in items]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(df, bench).collect()}
        assert set(got) == {(i, i) for i in range(100)} and min(got.values()) >= score


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 25))) for _ in range(10)]
    words = rng.choices(vocabulary, k=3000)
    for k, item in enumerate(items):
        words[290 * k + 40:290 * k + 40] = changed(item.split(), rng, "mixed", vocabulary)
    texts = [" ".join(words), " ".join(words[:900]), ""]
    block = decontam.ItemBlock(list(enumerate(items)))
    block.keep_seeds(block.counts(texts))
    whole = block.hits(texts)
    monkeypatch.setattr(decontam, "GROUP_WORDS", 250)
    monkeypatch.setattr(decontam, "CELLS", 500)
    assert block.hits(texts) == whole
    assert {(d, i, s) for d, found in enumerate(whole) for i, s, _, _ in found} == brute(texts, items)


def test_odd_input(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(1, item, 5.0, "x"), (1, item, 5.0, "x"), (1, "something else that shares no words", 1.0, None), (None, "Well: " + item, 2.0, "y"),
            (None, None, None, None), (2, "", 0.0, ""), (3, None, 0.0, ""), (4, "clean words " * 50_000 + item, 0.0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, digest string")
    bench = spark.createDataFrame([(7, item, "z"), (7, item, "z"), (8, None, None), (None, "another item that is not here at all", "")],
                                  "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["score"], r["first_word"]) for r in decontam.contaminated(df, bench).collect())
    assert got == [(0, 7, 1.0, 1), (1, 7, 1.0, 0), (1, 7, 1.0, 0), (4, 7, 1.0, 100_000)]
    left = decontam.decontaminate(df, bench)
    assert left.columns == df.columns
    assert sorted(tuple(map(str, r)) for r in left.collect()) == sorted(tuple(map(str, r)) for r in (rows[2], *rows[4:7]))
    for docs, items in ((df.where("false"), bench), (df, bench.where("false")), (df.where("false"), bench.where("false"))):
        assert decontam.contaminated(docs, items).count() == 0
        assert decontam.decontaminate(docs, items).count() == docs.count()
