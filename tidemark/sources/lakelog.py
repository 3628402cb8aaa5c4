"""The lake's commit log: which data files are live, what they hold, and how a commit replaces another.

Layout under a lake's root::

    <table>/commit=<id>/<partition columns>/part-*.parquet   data; a folder is written once and never changed
    _log/<version>/actions, _log/<version>/zones             one commit: files added and removed, and their zone maps
    _log/<version>.checkpoint/...                            all files live at that version

Data files say nothing by themselves: readers take the files that the log names.  A commit first writes its data and its
log entry to folders of its own and then publishes the entry by one rename to the next version number, which fails if
another writer took it (as Spark's own streaming metadata does; the store must rename without overwriting).  So a batch's
tables become visible together, a failed attempt leaves nothing visible, and a reader on one version is not
disturbed by later ones.  A writer that lost the race looks at the new version and tries again.

Zone maps: per file the rows, the range of times, the (writer, batch) ranges in it, and a Bloom filter of its keys
(session ids): one hash of about ten bits a key, cut into bitmaps of 32,768 bits that Spark's bitmap functions build.
A read with a scope picks its files from the log before any data folder is listed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32_768
BITS_PER_KEY = 10
#: Versions between two checkpoints of the log.
CHECKPOINT_EVERY = 20
#: Folder under a lake's root where batches at work keep rows between their steps.
STAGE = "_stage"

#: Columns every data file carries: the writer's epoch and its batch.
WRITER = T.StructField("writer", T.StringType())
BATCH = T.StructField("batch_id", T.LongType())

ACTIONS = T.StructType([
    T.StructField("action", T.StringType()), T.StructField("table", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("site_id", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("n_rows", T.LongType()),
    T.StructField("first_time", T.TimestampType()), T.StructField("last_time", T.TimestampType()), T.StructField("bits", T.LongType()),
    T.StructField("batches", T.ArrayType(T.StructType([T.StructField("writer", T.StringType()), T.StructField("low", T.LongType()),
                                                       T.StructField("high", T.LongType())])))])
ZONES = T.StructType([T.StructField("path", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("bitmap", T.BinaryType())])


class Conflict(Exception):
    """A file that this commit wants to replace is no longer live."""


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table that the optimizer knows to be empty: it starts no task and drops out of unions."""
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).limit(0)


# ---------------------------------------------------------------- files

def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if the target is there already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, _ = _fs(spark, target)
    a, b = (fs.makeQualified(jvm.org.apache.hadoop.fs.Path(x)) for x in (source, target))
    kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), conf).rename(a, b, options)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or exists(spark, target):
            return False
        raise
    return True


# ---------------------------------------------------------------- tables

@dataclass(frozen=True)
class Table:
    """How one table lies in the lake: columns, partition columns, and the columns that zone maps cover."""

    name: str
    schema: T.StructType
    partitions: tuple[str, ...] = ()
    time: str | None = None
    key: str | None = None

    @property
    def stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, WRITER, BATCH])

    def folder(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.name}"

    def read_files(self, spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
        """The rows of some of the table's files (paths under the table's folder), with ``writer`` and ``batch_id``."""
        if not paths:
            return no_rows(spark, self.stored)
        folder = self.folder(root)
        schema = T.StructType([*self.stored.fields, T.StructField("commit", T.StringType())])
        return (spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/{p}" for p in paths])
                .select(*self.stored.names))

    def write(self, df: DataFrame, root: str) -> str:
        """Write rows (with ``writer`` and ``batch_id``) to a commit folder of their own; returns its id.

        Rows are first brought together by partition column, and split and merged to the advisory size at run time, so
        the number of files follows the bytes and a hot (site, day) is written by many tasks.
        """
        commit = uuid.uuid4().hex
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in self.stored.fields])
        out.hint("rebalance", *[F.col(c) for c in self.partitions]).write.partitionBy(*self.partitions).parquet(f"{self.folder(root)}/commit={commit}")
        return commit

    def _log_rows(self, spark: SparkSession, root: str, commit: str) -> DataFrame:
        """What the log notes of a commit folder's rows, and the URI of each row's file."""
        schema = T.StructType([*self.stored.fields, T.StructField("commit", T.StringType())])
        rows = spark.read.schema(schema).option("basePath", self.folder(root)).parquet(f"{self.folder(root)}/commit={commit}")

        def or_null(name: str | None, kind: str) -> Column:
            return F.col(name).cast(kind) if name else F.lit(None).cast(kind)

        return rows.select(
            F.col("_metadata.file_path").alias("uri"), or_null("site_id" if "site_id" in self.partitions else None, "string").alias("site_id"),
            or_null("dt" if "dt" in self.partitions else None, "string").alias("dt"), "writer", "batch_id",
            or_null(self.time, "timestamp").alias("time"), or_null(self.key, "string").alias("key"))

    def added(self, spark: SparkSession, root: str, commit: str) -> DataFrame:
        """The log's rows about a commit folder: files added.  Read in one pass; paths are made once per file."""
        by_batch = self._log_rows(spark, root, commit).groupBy("uri", "site_id", "dt", "writer").agg(
            F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.min("batch_id").alias("low"),
            F.max("batch_id").alias("high"), F.approx_count_distinct("key").alias("keys")).withColumn("path", path_of("uri"))
        # room for the keys in whole bitmaps, a power of two of them
        bitmaps = F.pow(F.lit(2), F.ceil(F.greatest(F.log2(F.sum("keys") * BITS_PER_KEY / BITMAP_BITS), F.lit(0.0))))
        files = by_batch.groupBy("path", "site_id", "dt").agg(
            F.sum("n").alias("n_rows"), F.min("first").alias("first_time"), F.max("last").alias("last_time"),
            F.when(F.sum("keys") > 0, bitmaps.cast("long") * BITMAP_BITS).alias("bits"),
            F.array_sort(F.collect_list(F.struct("writer", "low", "high"))).alias("batches"))
        return files.select(F.lit("add").alias("action"), F.lit(self.name).alias("table"), *ACTIONS.names[2:])

    def zones(self, spark: SparkSession, root: str, commit: str, files: DataFrame) -> DataFrame:
        """The zone maps of a commit folder's files, whose log rows (:meth:`added`) are in ``files``."""
        if not self.key:
            return no_rows(spark, ZONES)
        bit = key_bit(F.col("key"), F.col("bits"))
        rows = self._log_rows(spark, root, commit).where(F.col("key").isNotNull()).select(path_of("uri").alias("path"), "key")
        return (rows.join(files.where((F.col("action") == "add") & (F.col("table") == self.name)).select("path", "bits"), "path")
                .groupBy("path", F.floor(bit / BITMAP_BITS).alias("bucket"))
                .agg(F.bitmap_construct_agg(bit % BITMAP_BITS).alias("bitmap")))


def path_of(uri: str) -> Column:
    """A file's path under its table's folder, from its URI form."""
    return F.concat(F.lit("commit="), F.substring_index(F.url_decode(F.replace(F.col(uri), F.lit("+"), F.lit("%2B"))), "/commit=", -1))


def key_bit(key: Column, bits: Column) -> Column:
    """The bit of a key in a file's filter."""
    return F.pmod(F.xxhash64(key), bits)


# ---------------------------------------------------------------- snapshots

@dataclass(frozen=True)
class Snapshot:
    """The lake at one version.  ``version`` -1 is the empty lake."""

    spark: SparkSession
    root: str
    version: int
    entries: tuple[str, ...] = field(default=())

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        paths = [f"{self.root}/_log/{e}/{part}" for e in self.entries]
        return self.spark.read.schema(schema).parquet(*paths) if paths else no_rows(self.spark, schema)

    @cached_property
    def live(self) -> DataFrame:
        """Log rows of the live files.  A path is added once, so no order matters: added and never removed."""
        actions = self._read("actions", ACTIONS)
        gone = actions.where("action = 'remove'").select("table", "path")
        return actions.where("action = 'add'").join(gone, ["table", "path"], "left_anti")

    @property
    def zones(self) -> DataFrame:
        return self._read("zones", ZONES)

    def files(self, table: Table, where: Column | None = None, start=None, end=None, keys: list[str] | None = None) -> DataFrame:
        """Log rows of the live files of ``table`` that may hold rows of the scope: ``where`` on ``site_id`` and
        ``dt``, times from ``start`` to ``end`` (inclusive), session ids among ``keys``."""
        out = self.live.where(F.col("table") == table.name)
        if where is not None:
            out = out.where(where)
        if start is not None:
            out = out.where(F.col("last_time") >= F.lit(start).cast("timestamp"))
        if end is not None:
            out = out.where(F.col("first_time") <= F.lit(end).cast("timestamp"))
        if keys is not None:
            asked = out.where(F.col("bits").isNotNull()).select(
                "path", F.explode(F.array(*[key_bit(F.lit(k), F.col("bits")) for k in keys]) if keys else F.array().cast("array<bigint>")).alias("bit"))
            # bit b of a bitmap is bit b % 8 of its byte b / 8
            spot = F.conv(F.hex(F.substring("bitmap", (F.col("bit") % BITMAP_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            held = (asked.join(self.zones, "path").where(F.col("bucket") == F.floor(F.col("bit") / BITMAP_BITS))
                    .where(F.getbit(spot, (F.col("bit") % 8).cast("int")) == 1).select("path").distinct())
            out = out.join(held, "path", "left_semi")
        return out

    def read(self, table: Table, **scope) -> DataFrame:
        """The rows of the files that :meth:`files` names (whole files: the caller still filters rows)."""
        paths = [r["path"] for r in self.files(table, **scope).select("path").collect()]
        return table.read_files(self.spark, self.root, sorted(paths))


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The lake's latest version, or an earlier one that the log still holds."""
    root = root.rstrip("/")
    names = names_in(spark, f"{root}/_log")
    commits = sorted(n for n in names if n.isdigit())
    marks = sorted(n for n in names if n.endswith(".checkpoint"))
    if version is not None:
        commits = [n for n in commits if int(n) <= version]
        marks = [n for n in marks if int(n.split(".")[0]) <= version]
    top = int(commits[-1]) if commits else -1
    if marks:
        at = int(marks[-1].split(".")[0])
        return Snapshot(spark, root, max(top, at), (marks[-1], *[n for n in commits if int(n) > at]))
    return Snapshot(spark, root, top, tuple(commits))


def _publish(spark: SparkSession, root: str, name: str, actions: DataFrame, zones) -> bool:
    """``zones``: a table, or a function that makes it from the written ``actions``."""
    stage = f"{root}/_log/.{uuid.uuid4().hex}"
    actions.select(*ACTIONS.names).coalesce(1).write.parquet(f"{stage}/actions")
    if callable(zones):
        zones = zones(spark.read.schema(ACTIONS).parquet(f"{stage}/actions"))
    zones.select(*ZONES.names).write.parquet(f"{stage}/zones")
    if rename_new(spark, stage, f"{root}/_log/{name}"):
        return True
    remove_folder(spark, stage)
    return False


def checkpoint(spark: SparkSession, root: str) -> None:
    """Write the live files of the latest version as one entry, which readers take instead of all commits before it."""
    snap = snapshot(spark, root)
    if snap.version >= 0:
        live = snap.live
        zones = snap.zones.join(live.select("path"), "path", "left_semi")
        _publish(spark, snap.root, f"{snap.version:020d}.checkpoint", live, zones)


@dataclass
class Commit:
    """One commit in the making: data written so far, and how to find what it replaces."""

    spark: SparkSession
    root: str
    written: list[tuple[Table, str]] = field(default_factory=list)

    def __post_init__(self):
        self.root = self.root.rstrip("/")

    def write(self, table: Table, df: DataFrame) -> None:
        self.written.append((table, table.write(df, self.root)))

    def _added(self):
        """Log rows of the files added, and a function that makes their zone maps from these rows, once written."""
        parts = [(t, c) for t, c in self.written
                 if any(n != "_SUCCESS" for n in names_in(self.spark, f"{t.folder(self.root)}/commit={c}"))]
        adds = [t.added(self.spark, self.root, c) for t, c in parts]

        def zones(actions: DataFrame) -> DataFrame:
            return reduce(DataFrame.unionByName, [t.zones(self.spark, self.root, c, actions) for t, c in parts], no_rows(self.spark, ZONES))

        return reduce(DataFrame.unionByName, adds, no_rows(self.spark, ACTIONS)), zones

    def publish(self, replaced, attempts: int = 50) -> int:
        """Publish at the next version and return it.

        ``replaced(snapshot)`` gives the log rows of the files that go (``None``: none); it is asked again whenever
        another commit came first, and may raise :class:`Conflict`.  It may also write more data with :meth:`write`.
        """
        for _ in range(attempts):
            before = list(self.written)
            snap = snapshot(self.spark, self.root)
            gone = replaced(snap)
            adds, zones = self._added()
            actions = adds if gone is None else adds.unionByName(gone.withColumn("action", F.lit("remove")).select(*ACTIONS.names))
            if _publish(self.spark, self.root, f"{snap.version + 1:020d}", actions, zones):
                if (snap.version + 1) % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
                    checkpoint(self.spark, self.root)
                return snap.version + 1
            for table, commit in self.written[len(before):]:
                remove_folder(self.spark, f"{table.folder(self.root)}/commit={commit}")
            self.written = before
        raise Conflict(f"no free version of {self.root} after {attempts} attempts")

    def abandon(self) -> None:
        """Remove what was written; nothing of it was visible."""
        for table, commit in self.written:
            remove_folder(self.spark, f"{table.folder(self.root)}/commit={commit}")
        self.written = []


def holds_batch(writer: str, batch_id: int) -> Column:
    """Does a file (a log row) possibly hold rows of this batch?"""
    return F.exists("batches", lambda b: b["writer"].eqNullSafe(F.lit(writer)) & (b["low"] <= batch_id) & (b["high"] >= batch_id))


def replace_batch(commit: Commit, tables: list[Table], writer: str, batch_id: int) -> int:
    """Publish ``commit`` as all there is of one batch: rows of an earlier attempt go, also out of merged files, whose
    other rows are written again."""
    def replaced(snap: Snapshot) -> DataFrame | None:
        names = [t.name for t in tables]
        old = snap.live.where(F.col("table").isin(names) & holds_batch(writer, batch_id))
        found = old.select("table", "path", F.size("batches").alias("writers"), F.col("batches")[0]["low"].alias("low"),
                           F.col("batches")[0]["high"].alias("high")).collect()
        if not found:
            return None
        for t in tables:
            merged = [r["path"] for r in found if r["table"] == t.name and (r["writers"] > 1 or r["low"] != r["high"])]
            if merged:
                rows = t.read_files(commit.spark, commit.root, sorted(merged))
                commit.write(t, rows.where(~(F.col("writer").eqNullSafe(F.lit(writer)) & (F.col("batch_id") == batch_id))))
        return old

    return commit.publish(replaced)


def merge_files(spark: SparkSession, root: str, table: Table, where: Column, change=None) -> int | None:
    """Write the live files of a scope again as few; returns the rows kept, None if there is nothing to merge.

    ``change``: a function on the rows, by default none.  The merged files keep each row's writer and batch.  A batch
    that commits meanwhile keeps its files; if a merged file itself is replaced meanwhile, the merge starts over.
    """
    while True:
        snap = snapshot(spark, root)
        files = snap.files(table, where=where)
        found = files.select("path", "n_rows").collect()
        if not found:
            return None
        paths = [r["path"] for r in found]
        commit = Commit(spark, root)
        rows = table.read_files(spark, snap.root, sorted(paths))
        commit.write(table, change(rows) if change else rows)

        def replaced(now: Snapshot, files=files, n=len(paths)) -> DataFrame:
            if now.version != snap.version and now.live.join(files.select("path"), "path", "left_semi").count() != n:
                raise Conflict("a merged file was replaced")
            return files

        try:
            commit.publish(replaced)
            return sum(r["n_rows"] for r in found)
        except Conflict:
            commit.abandon()


def expire(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete data files that no kept version names, and log entries before the oldest kept checkpoint.

    Keeps the last ``keep`` checkpoints and all later versions.  Commit and stage folders of attempts that failed go as well, so run it while
    no writer is at work, or keep folders younger than your longest batch.  Returns the number of files removed.
    """
    checkpoint(spark, root)
    root = root.rstrip("/")
    names = names_in(spark, f"{root}/_log")
    marks = sorted(n for n in names if n.endswith(".checkpoint"))
    oldest = int(marks[-keep:][0].split(".")[0])
    kept = snapshot(spark, root, oldest)
    later = [n for n in names if n.isdigit() and int(n) > oldest]
    named = kept.live.select("table", "path")
    if later:
        named = named.union(Snapshot(spark, root, oldest, tuple(later))._read("actions", ACTIONS).where("action = 'add'").select("table", "path"))
    named = named.distinct().persist()
    removed = 0
    try:
        for table in sorted(n for n in names_in(spark, root) if not n.startswith("_")):
            known = {r[0] for r in named.where(F.col("table") == table).select(F.substring_index("path", "/", 1)).distinct().collect()}
            for folder in names_in(spark, f"{root}/{table}"):
                if folder not in known:
                    remove_folder(spark, f"{root}/{table}/{folder}")
                    removed += 1
    finally:
        named.unpersist()
    for n in names:
        if (n.isdigit() and int(n) <= oldest) or (n.endswith(".checkpoint") and int(n.split(".")[0]) < oldest) or n.startswith("."):
            remove_folder(spark, f"{root}/_log/{n}")
    remove_folder(spark, f"{root}/{STAGE}")
    return removed
