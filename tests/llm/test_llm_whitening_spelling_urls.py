"""Whitening, spelling variants and URL rules against brute force, and on nulls, ties, repeated rows, empty tables, long and odd values."""

import itertools
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from compare import rows_of  # noqa: E402
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.llm import spelling, url_rules, whitening
from tidemark.llm.common import documents
from tidemark.llm.oracles import ORACLES

VECTORS = "vec_id long, embedding array<float>, n int, component string"


# --- whitening ---

def brute_white(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(row, s)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return centred, values[::-1], axes[:, ::-1], [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]


def test_whitening_equals_eigh(spark):
    vectors = spark.read.parquet(f"{SF001}/embeddings.parquet")
    out = whitening.whitened_rows(vectors).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    centred, values, axes, deviation = brute_white([v for _, v in rows])
    w = out.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    assert w.shape == (len(rows), 32) and set(out["n"]) == {len(rows)}
    brute = centred @ axes[:, :32] / np.sqrt(values[:32])
    assert np.abs(w * np.sign((w * brute).sum(axis=0)) - brute).max() < 1e-8
    assert np.allclose(out.groupby("component")["explained"].first(), values[:32] / values.sum(), rtol=1e-10)
    assert dict(zip(out["vec_id"], out["deviation"])) == dict(zip([i for i, _ in rows], deviation))
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9
    assert np.abs(w.T @ w / len(w) - w.mean(axis=0)[:, None] * w.mean(axis=0) - np.eye(32)).max() < 1e-9


def test_whitening_drops_unusable_rows_and_keeps_repeated_ones(spark):
    good = [(1, [1.0, 2.0, 3.0]), (2, [0.5, -2.0, 1.0]), (2, [0.5, -2.0, 1.0]), (None, [3.0, 0.0, 0.25]), (4, [-1.0, -1.5, 9.0])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [1.0, float("nan"), 2.0]), (8, [1.0, float("inf"), 2.0]), (9, [1.0, 2.0]),
           (10, []), (11, [3e38, 1.0, 1.0])]
    out = whitening.whitened_rows(spark.createDataFrame([(i, v, 5, "x") for i, v in good + bad], VECTORS)).collect()
    assert Counter(r["vec_id"] for r in out) == Counter({1: 3, 2: 6, None: 3, 4: 3})
    assert {r["n"] for r in out} == {5} and out[0]["identity_error"] < 1e-9
    deviation = brute_white([v for _, v in good])[3]
    assert Counter((r["vec_id"], r["deviation"]) for r in out if r["component"] == 1) == Counter(zip([i for i, _ in good], deviation))


def test_whitening_equal_and_zero_eigenvalues(spark):
    # a centred cross: one eigenvalue three times, and a constant dimension without any spread
    cross = [[s if i == j else 0.0 for i in range(3)] + [7.5] for j in range(3) for s in (4.0, -4.0)]
    out = whitening.whitened_rows(spark.createDataFrame([(i, v, 0, "") for i, v in enumerate(cross)], VECTORS)).toPandas()
    assert sorted(set(out["component"])) == [1, 2, 3] and np.allclose(out["explained"], 1 / 3) and out["identity_error"][0] < 1e-12
    same = spark.createDataFrame([(i, [1.0, 2.0], 0, "") for i in range(4)], VECTORS)
    assert whitening.whitened_rows(same).count() == 0
    assert whitening.whitened_rows(same.where("vec_id = 0")).count() == 0
    assert whitening.whitened_rows(same.where("false")).count() == 0
    assert whitening.whitened_rows(same.where("false")).columns == out.columns.tolist()


def test_large_values_stay_exact(spark):
    big = [[2.0 ** 40, 1.0], [-(2.0 ** 41), 3.0], [2.0 ** 39, -2.0], [0.0, 1.0]]
    out = whitening.whiten(spark.createDataFrame([(i, v, 0, "") for i, v in enumerate(big)], VECTORS)).toPandas()
    got = dict(zip(out["vec_id"], out["deviation"]))
    assert [int(got[i]) for i in range(4)] == brute_white(big)[3]


def test_characteristic_polynomial_and_roots(spark):
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (2, 1), (5, 5), (7, 4)):
        a = rng.integers(-9, 10, (d, rank)).astype(object)
        m = a @ a.T
        e = whitening.elementary(spark, m)
        # Newton's identities in fractions, from traces of powers
        power, sums = np.eye(d, dtype=object), []
        for _ in range(d):
            power = power @ m
            sums.append(int(np.trace(power)))
        brute = [Fraction(1)]
        for k in range(1, d + 1):
            brute.append(sum((-1) ** (i - 1) * brute[k - i] * sums[i - 1] for i in range(1, k + 1)) / Fraction(k))
        assert e == [int(x) for x in brute]
        roots = [float(v) for v, mult in whitening.largest_roots(e, d) for _ in range(mult)]
        exact = np.linalg.eigvalsh(m.astype(float))[::-1][:len(roots)]
        assert np.allclose(roots, exact, rtol=1e-9) and len(roots) == np.linalg.matrix_rank(m.astype(float))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 9))
def test_roots_with_multiplicities(roots, count):
    e = [1]
    for r in roots:
        e = [(e[k] if k < len(e) else 0) + (r * e[k - 1] if k else 0) for k in range(len(e) + 1)]
    found = [v for v, mult in whitening.largest_roots(e, count) for _ in range(mult)]
    expected = sorted(roots, reverse=True)
    assert len(found) >= min(count, len(roots))
    assert all(abs(f - x) <= Fraction(x, 2 ** 100) for f, x in zip(found, expected))
    assert all(whitening.roots_above([c if k % 2 == 0 else -c for k, c in enumerate(e)], Fraction(2 * a + 1, 2))
               == sum(r > a for r in roots) for a in (0, 3, 20, 49))


# --- spelling ---

def brute_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1:] == b[k + 1:] or a[k:] == b[k + 1:] or a[k + 1:] == b[k:]


def brute_groups(counts):
    near = defaultdict(list)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in near}
    form = {w: b for w, b in best.items() if counts[b] >= 5 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), counts[w], len(near[w]), counts[form[w]] if w in form else None) for w in words}


def groups(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_spelling_equals_brute_force(spark):
    docs = documents(spark, SF001)
    counts = brute_vocabulary([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert groups(spelling.spelling_variants(docs)) == brute_groups(counts)


def test_spelling_on_odd_rows(spark):
    words = ["colour"] * 125 + ["colours"] * 25 + ["coloures"] * 5 + ["colouur"] * 5 + ["Àéîõü÷×"] * 6 + ["Àéîõü÷"] * 40 + ["short"] * 50 + ["x" * 20000] * 6 + ["x" * 19999] * 40
    rows = [(None, " ".join(words)), (1, None), (2, ""), (3, "COLOUR, Colour; colour_colour1colour " * 3), (3, "COLOUR, Colour; colour_colour1colour " * 3)]
    docs = spark.createDataFrame([(i, t, "w", 1, None) for i, t in rows], "doc_id long, text string, word string, n int, form string")
    found = groups(spelling.spelling_variants(docs))
    assert found == brute_groups(brute_vocabulary(rows))
    assert ("coloures", "colours", "colour", 5, 1, 25) in found and any(len(r[0]) == 20000 and len(r[2]) == 19999 for r in found)
    assert spelling.spelling_variants(docs.where("false")).count() == 0
    assert spelling.spelling_variants(docs.where("doc_id = 1")).count() == 0


def test_chain_of_forms_and_ties(spark):
    counts = {"aaaaaaa" + "b" * k: 5 ** (k + 1) for k in range(1, 10)} | {"zzzzzza": 50, "zzzzzzb": 50, "zzzzzzc": 10}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = groups(spelling.spelling_groups(df))
    assert found == brute_groups(counts)
    assert {r[2] for r in found if r[0].startswith("a")} == {"aaaaaaa" + "b" * 9} and ("zzzzzzc", "zzzzzza", "zzzzzza", 10, 2, 50) in found


@pytest.mark.parametrize("letters, q_max, share", [("ab", 3, 0.01), ("abcde", 3, 0.05), ("abcdé", 4, 0.02), ("abc", 2, 0.5)])
def test_near_words_of_random_words(spark, letters, q_max, share):
    rng = random.Random(5)
    words = {"".join(rng.choices(letters, k=rng.randint(2 * q_max, 2 * q_max + 5))) for _ in range(500)}
    df = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    found = {(r["a"], r["b"]) for r in spelling.near_words(df, q_max=q_max, share=share).collect()}
    assert {tuple(sorted(p)) for p in found} == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(found) == len({tuple(sorted(p)) for p in found})


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=6, max_size=14), st.integers(0, 13), st.sampled_from("abcd"), st.sampled_from(["in", "out", "new"]),
       st.sets(st.text("abc", min_size=3, max_size=3)))
def test_affected_grams_bound_shared_ones(word, at, letter, kind, extended):
    at = min(at, len(word) - (kind != "in"))
    other = word[:at] + (letter if kind != "out" else "") + word[at + (kind != "in"):]
    made = spelling.Decomposer({a + b for a in "abcd" for b in "abcd"} | extended)
    mine, theirs = made.decompose(word), made.decompose(other)
    shift = len(other) - len(word)
    shared = sum((p, g) in theirs or (p + shift, g) in theirs for p, g in mine)
    assert shared >= len(mine) - made.most_affected(word, mine) >= 1


# --- URL rules ---

ODD_URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/EN/1", "http://example.com", "http://example.com/en", "http://a.example.com/en/x?q=1#f",
            "http://www.example.com/en/1", "http://a.www.example.com/en/1", "http://notexample.com/en/1", "http://com/", "http://x.net/es/", "http://net/fr/9",
            "http://x.net/ES/", "://net/es/1", "a://b://c.com/d", "http://x.net?u=://y.com/", "http://x.net#/fr/", "http://x.com:80/", "line\nfeed://x.net/fr/\na?b#c",
            "http://x.org/" + "/".join(f"p{i}a" for i in range(400)), "http://é.com/ü?ß=1&&=2&a", "http://x.org/1/2/3"]


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


def judged(pages, labelled, **kw):
    return url_rules.filter_urls(pages, labelled, **kw).collect()


def odd_pages(spark):
    rows = [(i, u, "h", "r", True) for i, u in enumerate(ODD_URLS)] + [(None, ODD_URLS[4], None, None, None), (4, ODD_URLS[4], None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string, blocked boolean")


def test_written_rules(spark):
    pages = odd_pages(spark)
    none = spark.createDataFrame([], "url string, blocked boolean")
    out = judged(pages, none)
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["mined"]) for r in out)
    want = Counter()
    for r in pages.collect():
        host, path, rule, verdict = brute_rule(r["url"])
        want[r["page_id"], host, path, rule, verdict or "allow", None] += 1
    assert got == want
    assert judged(pages.where("false"), none) == []


def planted(spark):
    """Blocked: hosts of a farm under /win/; the host and the path part alone are mostly clean."""
    rng = random.Random(2)
    rows = []
    for i in range(900):
        host, part = rng.choice(["farm", "calm", "tidy"]), rng.choice(["win", "read", "news"])
        bad = (host, part) == ("farm", "win") and rng.random() < 0.95
        rows.append((f"https://{host}.site.org/{part}/{i}.html?page={i}", bad))
    rows += [("https://farm.site.org/win/1", None), (None, True), ("nothing", False)]
    return spark.createDataFrame(rows, "url string, blocked boolean")


def test_mined_rules_find_a_combination(spark):
    rules = url_rules.mine(planted(spark)).collect()
    assert [sorted(r["tokens"]) for r in rules] != [] and all(
        any(t.endswith(("farm", "farm.site.org")) for t in r["tokens"]) and any(t == "path:win" for t in r["tokens"]) for r in rules)
    assert all(r["confidence"] >= url_rules.MIN_CONFIDENCE and r["anchor"] in r["tokens"] for r in rules)
    pages = spark.createDataFrame([(1, "https://farm.site.org/win/77.html?page=1"), (2, "https://farm.site.org/read/7.html"),
                                   (3, "https://calm.site.org/win/5.html"), (4, "https://farm.site.net/es/win/1.html"), (5, None)], "page_id long, url string")
    out = {r["page_id"]: r for r in judged(pages, planted(spark))}
    assert [out[i]["verdict"] for i in range(1, 6)] == ["block", "allow", "allow", "block", "allow"]
    assert out[1]["mined"] and not out[2]["mined"] and out[4]["rule"] == "net/es/" and out[4]["mined"] is None


def test_mined_rules_equal_brute_force(spark):
    """Rules from all subsets of every labelled URL's chosen tokens, counted in Python."""
    rows = [(r["url"], r["blocked"], r["tokens"]) for r in planted(spark).withColumn("tokens", url_rules.url_tokens(F.col("url"))).collect()
            if r["blocked"] is not None]
    total, bad = len(rows), sum(b for _, b, _ in rows)
    least = max(url_rules.MIN_URLS, -(-total // url_rules.ONE_IN))
    n, n_bad = Counter(t for _, _, ts in rows for t in ts), Counter(t for _, b, ts in rows if b for t in ts)
    seen, seen_bad = Counter(), Counter()
    for _, b, ts in rows:
        items = sorted(sorted((t for t in ts if n[t] >= least), key=lambda t: (-abs(n_bad[t] * total - n[t] * bad), t))[:url_rules.MINED_TOKENS])
        for mask in range(1, 1 << len(items)):
            part = tuple(t for i, t in enumerate(items) if mask >> i & 1)
            seen[part] += 1
            seen_bad[part] += b
    sure = {p for p, k in seen_bad.items() if k >= least and k / seen[p] >= url_rules.MIN_CONFIDENCE}
    minimal = {p for p in sure if not any(set(q) < set(p) for q in sure)}
    assert {tuple(sorted(r["tokens"])): r["n_urls"] for r in url_rules.mine(planted(spark)).collect()} == {p: seen[p] for p in minimal}


def test_mined_rules_use_all_tokens_of_long_urls(spark):
    """Only two path parts together tell blocked URLs, and a dozen others in the same URLs are more telling one by one."""
    rng, rows = random.Random(4), []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        bad = a != b if i % 2 else a and b
        noise = [f"n{k}x" for k in range(14) if rng.random() < (0.6 if bad else 0.3)]
        rows.append(("https://z.org/" + "/".join(noise + ["left"] * a + ["right"] * b + ["pair"] * (a and b and i % 2 == 0)), bad))
    tokens = [frozenset(r["t"]) for r in spark.createDataFrame(rows, "url string, blocked boolean").select(url_rules.url_tokens(F.col("url")).alias("t")).collect()]
    got = {tuple(sorted(r["tokens"])): (r["n_urls"], r["confidence"]) for r in
           url_rules.mine(spark.createDataFrame(rows, "url string, blocked boolean"), min_urls=60).collect()}
    n = {}
    sure = []
    names = sorted(set().union(*tokens))
    for size in (1, 2, 3):
        for part in itertools.combinations(names, size):
            held = [bad for t, (_, bad) in zip(tokens, rows) if t.issuperset(part)]
            if sum(held) >= 60 and sum(held) / len(held) >= url_rules.MIN_CONFIDENCE and not any(set(q) < set(part) for q in sure):
                sure.append(part)
                n[part] = len(held), sum(held) / len(held)
    assert n and {p: v for p, v in got.items() if len(p) <= 3} == n


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/7"), (2, "http://a.org/en/8/x.html"), (3, "http://a.org/9?x=7"), (4, "http://a.org/99999999999999999999"), (5, None)],
                                  "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, 1, 0), (9, 1, None), (9, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["url"]: r["blocked"] for r in url_rules.labelled_pages(pages, labels).collect()}
    assert got == {"http://a.org/en/7": True, "http://a.org/en/8/x.html": False, "http://a.org/9?x=7": None}


@pytest.mark.parametrize("kind", ["supplied", "planted", "odd"])
def test_url_rules_equal_their_twin(spark, tmp_path, kind):
    if kind == "supplied":
        pages, labels = spark.read.parquet(f"{SF001}/pages.parquet"), spark.read.parquet(f"{SF001}/labels.parquet")
    elif kind == "planted":
        numbered = planted(spark).where("blocked IS NOT NULL AND url LIKE '%page%'").withColumn("page_id", F.regexp_extract("url", "([0-9]+)$", 1).cast("long"))
        pages = numbered.select("page_id", F.regexp_replace("url", r"\?.*", "").alias("url"))
        labels = numbered.select(F.col("page_id").alias("doc_id"), (~F.col("blocked")).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    else:
        pages, labels = odd_pages(spark), spark.createDataFrame([(1, 0, 0), (1, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    with duckdb.connect() as con:
        for name, df in (("pages", pages), ("labels", labels)):
            df.write.parquet(str(tmp_path / name))
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
        out = url_rules.filter_urls(pages, url_rules.labelled_pages(pages, labels))
        cur = con.execute(ORACLES["op13_url_rules"])
        columns, rows = [c[0] for c in cur.description], cur.fetchall()
    got = [tuple(r) for r in out.collect()]
    assert sorted(out.columns) == sorted(columns) and rows_of(out.columns, got, 9) == rows_of(columns, rows, 9)
    assert kind != "planted" or any(r[4] == "block" for r in got)
