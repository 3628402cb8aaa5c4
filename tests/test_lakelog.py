"""The lake's commit log: replays around compaction, concurrent commits, file skipping, the ledger's totals."""

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import scope
from tidemark.plans.jobs import ingest_to_lake, merge_ledger, read_ledger, remaining_allowance
from tidemark.sinks import lake as sink
from tidemark.sources import lake as src
from tidemark.sources import lakelog

DAY = "2024-01-01"


def sites(spark, allowance=1000, name="a"):
    return spark.createDataFrame([(name, "o", "n", [], "free_tier", allowance, [], "maybe", None, None)], S.SITES)


def requests(spark, n, batch, site="a", day=DAY, sessions=3):
    rows = [(f"r{batch}-{i}", site, f'{{"event":"click","session_id":"s{batch}-{i % sessions}"}}', f"{day} 10:{batch:02d}:{i % 60:02d}") for i in range(n)]
    df = spark.createDataFrame(rows, "request_id string, site string, body string, t string")
    return df.select("request_id", F.col("t").cast("timestamp").alias("received_at"), "site",
                     F.create_map().cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("context_user_agent"), "body")


def put(spark, root, n, batch, site="a", day=DAY, sessions=3):
    """One batch of regular events and usage, written without the request checks."""
    r = requests(spark, n, batch, site, day, sessions)
    ev = r.select(F.col("site").alias("site_id"), F.lit(day).alias("dt"), F.lit("click").alias("event"), F.lit("/").alias("pathname"),
                  F.get_json_object("body", "$.session_id").alias("session_id"), F.col("received_at").alias("timestamp"),
                  F.create_map().cast("map<string,string>").alias("properties"))
    use = spark.createDataFrame([(site, n, False)], "site_id string, used long, merged boolean")
    sink.write_batch(spark, root, {"events": ev, "usage": use}, batch)


def rows(spark, root):
    return sorted((r["writer"], r["batch_id"], r["session_id"], str(r["timestamp"])) for r in src.read_events(spark, root).collect())


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_replay_after_compaction_in_any_order(spark, scratch, order):
    s, batch = sites(spark), {0: requests(spark, 5, 0), 1: requests(spark, 7, 1)}
    for b in (0, 1):
        ingest_to_lake(spark, batch[b], s, scratch, b)
    want = rows(spark, scratch)
    assert len(want) == 12 and sink.compact(spark, scratch, "events", "a", DAY) == 12
    assert rows(spark, scratch) == want
    assert lakelog.snapshot(spark, scratch).files(src.EVENTS).count() == 1
    for b in order:
        ingest_to_lake(spark, batch[b], s, scratch, b)
        assert rows(spark, scratch) == want
        assert sorted((r["batch_id"], r["used"]) for r in read_ledger(spark, scratch).collect()) == [(0, 5), (1, 7)]
    sink.compact(spark, scratch, "events", "a", DAY)
    assert rows(spark, scratch) == want


def test_replay_with_other_content_leaves_no_old_rows(spark, scratch):
    put(spark, scratch, 5, 0)
    put(spark, scratch, 4, 1)
    sink.compact(spark, scratch, "events", "a", DAY)
    put(spark, scratch, 2, 0, day="2024-01-02")
    got = rows(spark, scratch)
    assert [r[1] for r in got] == [0, 0, 1, 1, 1, 1] and all(r[3].startswith("2024-01-02") for r in got if r[1] == 0)


def test_a_batch_that_commits_during_a_merge_survives(spark, scratch, monkeypatch):
    for b in (0, 1):
        put(spark, scratch, 5, b)
    publish, late = lakelog._publish, []

    def slow_publish(*args):
        if not late:  # between reading the files and publishing their merge, batch 2 commits and batch 0 is replayed
            late.append(1)
            put(spark, scratch, 3, 2)
            put(spark, scratch, 6, 0)
        return publish(*args)

    monkeypatch.setattr(lakelog, "_publish", slow_publish)
    sink.compact(spark, scratch, "events", "a", DAY)
    assert [r[1] for r in rows(spark, scratch)] == [0] * 6 + [1] * 5 + [2] * 3
    versions = [n for n in lakelog.names_in(spark, scratch + "/_log") if n.isdigit()]
    assert len(versions) == 5 and not [n for n in lakelog.names_in(spark, scratch + "/_log") if n.startswith(".")]


def test_a_version_is_published_once(spark, scratch):
    empty = spark.createDataFrame([], lakelog.ACTIONS), spark.createDataFrame([], lakelog.ZONES)
    assert lakelog._publish(spark, scratch, f"{0:020d}", *empty)
    assert not lakelog._publish(spark, scratch, f"{0:020d}", *empty)
    assert lakelog.names_in(spark, scratch + "/_log") == [f"{0:020d}"]


def test_readers_keep_their_version_and_expire_cleans_up(spark, scratch):
    for b in (0, 1):
        put(spark, scratch, 5, b)
    old = lakelog.snapshot(spark, scratch)
    before = old.read(src.EVENTS)
    sink.compact(spark, scratch, "events", "a", DAY)
    assert before.count() == 10 and lakelog.snapshot(spark, scratch, old.version).read(src.EVENTS).count() == 10
    want = rows(spark, scratch)
    lakelog.expire(spark, scratch)
    assert len(lakelog.names_in(spark, scratch + "/events")) == 1
    assert rows(spark, scratch) == want and lakelog.names_in(spark, scratch + "/_log") == [f"{old.version + 1:020d}.checkpoint"]
    put(spark, scratch, 4, 2)
    assert len(rows(spark, scratch)) == 14


def test_checkpoints_give_the_same_lake(spark, scratch, monkeypatch):
    monkeypatch.setattr(lakelog, "CHECKPOINT_EVERY", 2)
    for b in (0, 1, 2, 1, 0):
        put(spark, scratch, 3 + b, b)
    assert len(lakelog.snapshot(spark, scratch).entries) == 2  # a checkpoint and one commit
    assert [r[1] for r in rows(spark, scratch)] == [0] * 3 + [1] * 4 + [2] * 5
    assert src.read_events(spark, scratch, keys=["s2-1"]).count() == 5


def test_a_failed_batch_leaves_nothing(spark, scratch):
    put(spark, scratch, 5, 0)
    bad = src.read_events(spark, scratch).select(F.raise_error(F.lit("stop")).alias("session_id"), *[c for c in S.names(S.COMMON_FIELDS) if c != "session_id"])
    with pytest.raises(Exception, match="stop"):
        sink.write_batch(spark, scratch, {"events": bad}, 1)
    assert len(rows(spark, scratch)) == 5 and len(lakelog.names_in(spark, scratch + "/events")) == 1


def test_scoped_reads_open_matching_files_only(spark, scratch):
    for b, (site, day) in enumerate([("a", DAY), ("a", "2024-01-02"), ("b", DAY), ("a", DAY)]):
        put(spark, scratch, 40, b, site=site, day=day, sessions=20)

    def opened(df):
        return len(df.inputFiles())

    read = lambda *a, **k: scope.scoped_read(spark, scratch, src.EVENTS, *a, **k)
    assert opened(src.read_events(spark, scratch)) == 4
    assert opened(read(["a"], DAY, DAY)) == 2 and opened(read(["a", "b"], DAY, "2024-01-09")) == 4
    assert opened(read(["b"], "2024-01-02", "2024-01-09")) == 0 and read(["b"], "2024-01-02", "2024-01-09").count() == 0
    one = read(["a", "b"], DAY, "2024-01-09", session_ids=["s3-7"])
    assert opened(one) == 1 and one.count() == 2 and "batch_id" in one.columns
    two = read(["a", "b"], DAY, "2024-01-09", session_ids=["s3-7", "s1-0", "none"])
    assert opened(two) == 2 and two.count() == 4
    frame = spark.createDataFrame([("b",), ("zz",)], "site_id string")
    assert opened(read(frame, DAY, DAY)) == 1 and read(frame, DAY, DAY).count() == 40
    late = src.read_events(spark, scratch, start=f"{DAY} 10:02:30", end=f"{DAY} 10:59:00")
    assert opened(late) == 2 and late.count() == 80  # whole files: batches 2 and 3


def test_bloom_filter_has_no_false_negative_and_few_false_positives(spark, scratch):
    df = spark.range(200_000).select(F.lit("a").alias("site_id"), F.lit(DAY).alias("dt"), F.lit("click").alias("event"), F.lit("/").alias("pathname"),
                                     F.concat(F.lit("k"), F.col("id").cast("string")).alias("session_id"),
                                     F.lit(f"{DAY} 10:00:00").cast("timestamp").alias("timestamp"), F.create_map().cast("map<string,string>").alias("properties"))
    sink.write_batch(spark, scratch, {"events": df}, 0)
    snap = lakelog.snapshot(spark, scratch)
    assert snap.zones.count() > 32  # several bitmaps a file
    assert all(snap.files(src.EVENTS, keys=[f"k{i}"]).count() >= 1 for i in (0, 99_999, 199_999))
    hits = sum(snap.files(src.EVENTS, keys=[f"other{i}"]).count() > 0 for i in range(12))
    assert hits <= 6
    assert not snap.files(src.EVENTS, keys=[]).count()


def test_partition_names_of_any_kind(spark, scratch):
    names = ["a b", "ü+%20", "x:y=z", "q[1]*{2}?", "it's"]
    ev = spark.createDataFrame([(n, f"s{i}") for n in names for i in range(4)], "site_id string, session_id string").select(
        "site_id", F.lit(DAY).alias("dt"), F.lit("click").alias("event"), F.lit("/").alias("pathname"), "session_id",
        F.lit(f"{DAY} 10:00:00").cast("timestamp").alias("timestamp"), F.create_map().cast("map<string,string>").alias("properties"))
    sink.write_batch(spark, scratch, {"events": ev}, 0)
    assert sink.compact(spark, scratch, "events", names[3], DAY) == 4
    for n in names:
        got = scope.scoped_read(spark, scratch, src.EVENTS, [n], DAY, DAY)
        assert len(got.inputFiles()) == 1 and [r["site_id"] for r in got.collect()] == [n] * 4


def test_ledger_merge_keeps_totals_and_the_newest_batch(spark, scratch):
    s = sites(spark, allowance=20)
    for b, n in enumerate([5, 4, 3]):
        ingest_to_lake(spark, requests(spark, n, b), s, scratch, b)
    merge_ledger(spark, scratch)
    got = sorted((r["merged"], r["batch_id"], r["used"]) for r in read_ledger(spark, scratch).collect())
    assert got == [(False, 2, 3), (True, 1, 9)] and lakelog.snapshot(spark, scratch).files(src.USAGE).count() == 1
    assert ingest_to_lake(spark, requests(spark, 3, 2), s, scratch, 2) == {"202": 3}  # the newest batch may be replayed
    assert ingest_to_lake(spark, requests(spark, 4, 1), s, scratch, 1) == {}          # an older one is complete
    assert remaining_allowance(spark, s, scratch, 3).first()["request_allowance"] == 8
    assert ingest_to_lake(spark, requests(spark, 10, 3), s, scratch, 3) == {"202": 8, "402": 2}
    merge_ledger(spark, scratch)
    merge_ledger(spark, scratch)
    assert sorted((r["merged"], r["batch_id"], r["used"]) for r in read_ledger(spark, scratch).collect()) == [(False, 3, 8), (True, 2, 12)]


def test_a_stream_without_its_checkpoint_loses_no_usage(spark, scratch):
    from tidemark.streaming.ingest_stream import start_ingest

    s, lake = sites(spark, allowance=20), scratch + "/lake"

    def run(batch, n, checkpoint):
        requests(spark, n, batch).write.mode("append").option("timestampFormat", src.JSON_TS).json(f"{scratch}/in{batch}")
        start_ingest(spark, f"{scratch}/in{batch}", lambda: s, lake, checkpoint=f"{scratch}/{checkpoint}", available_now=True).awaitTermination()

    run(0, 8, "first")
    run(1, 8, "second")  # counts its batches from 0 again
    ledger = read_ledger(spark, lake).collect()
    assert sorted((r["batch_id"], r["used"]) for r in ledger) == [(0, 8), (0, 8)] and len({r["writer"] for r in ledger}) == 2
    assert src.read_events(spark, lake).count() == 16
    assert remaining_allowance(spark, s, lake, 0, "third").first()["request_allowance"] == 4
    assert remaining_allowance(spark, s, lake, 0, ledger[0]["writer"]).first()["request_allowance"] == 12


def test_a_commit_reads_its_rows_twice(spark, scratch):
    """Once for the log rows, once for the zone maps, which take the files from the written log rows; nothing empty runs."""
    commit = lakelog.Commit(spark, scratch)
    df = spark.createDataFrame([("s%d" % i, i) for i in range(9)], "session_id string, n int").selectExpr("*", "'w' AS writer", "0L AS batch_id")
    table = lakelog.Table("t", df.drop("writer", "batch_id").schema, (), None, "session_id")
    commit.write(table, df)
    adds, zones = commit._added()
    plans = []
    for d in (adds, zones(spark.range(1).limit(0).selectExpr(*[f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in lakelog.ACTIONS]))):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
    assert plans[0].count("FileScan parquet") == 1 and "ExistingRDD" not in plans[0] + plans[1]
    assert commit.publish(lambda snap: None) == 0
    snap = lakelog.snapshot(spark, scratch)
    assert snap.read(table, keys=["s3"]).count() == 9 and snap.zones.count() == 1 and snap.live.first()["n_rows"] == 9
