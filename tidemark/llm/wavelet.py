"""Token-id files: one wavelet matrix per shard.

A shard's token ids are stored as bit planes, highest bit first; after each plane the ids are
stably parted into those with a 0 and those with a 1.  A plane carries the number of ones before every
512th bit, so rank and select, and with them access to a position, the count of a token and
the place of its k-th occurrence, read a few words of each plane and decode nothing else.

File format: a shard is one binary value: a header, then its documents (first id, count), then
the planes with their rank directories, all under one zstd frame.  Shards are rows of a Parquet folder,
so Spark's commit protocol makes a lost executor's or a retried task's shards whole, on any file system
that Spark reaches.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import word_bpe
from tidemark.llm.common import CACHE_ENTRIES, fresh_path, id_text, texts_of, tokenizer_path

#: Appended to each document.
END_ID = 2
#: A shard is closed once it holds this many ids; a longer document makes a longer shard.
SHARD_IDS = 1 << 19
BLOCK = 512
#: Characters of all chunks that an encoder's cache may hold; beyond them it is emptied.
CACHE_CHARS = 1 << 26
HEAD = struct.Struct("<4sIQQ")
MAGIC = b"WMX1"


class WaveletMatrix:
    """Succinct sequence of ids below ``2 ** width``."""

    def __init__(self, width: int, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.width, self.n, self.planes, self.zeros, self.ranks = width, n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max(initial=0)).bit_length())
        row = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(width - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            ranks.append(cls._directory(packed))
            row = np.concatenate([row[~bit], low := row[bit]])
            zeros.append(len(row) - len(low))
        return cls(width, len(row), planes, zeros, ranks)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        padded = np.zeros(-(-max(1, packed.size) // 64) * 64, np.uint8)
        padded[:packed.size] = packed
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, 8).sum(axis=1)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def to_bytes(self) -> bytes:
        return b"".join([struct.pack("<BQ", self.width, self.n), np.array(self.zeros, "<u8").tobytes(),
                         *(p.tobytes() for p in self.planes), *(r.astype("<u4").tobytes() for r in self.ranks)])

    @classmethod
    def from_bytes(cls, blob) -> WaveletMatrix:
        width, n = struct.unpack_from("<BQ", blob)
        at = 9
        zeros = np.frombuffer(blob, "<u8", width, at).tolist()
        at += 8 * width
        size, blocks = -(-n // 8), -(-max(1, -(-n // 8)) // 64) + 1
        planes = [np.frombuffer(blob, np.uint8, size, at + k * size) for k in range(width)]
        at += width * size
        ranks = [np.frombuffer(blob, "<u4", blocks, at + 4 * k * blocks) for k in range(width)]
        return cls(width, n, planes, zeros, ranks)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        block = i // BLOCK
        first = block * (BLOCK // 8)
        inside = self.planes[k][first:(i >> 3)]
        rest = int(self.planes[k][i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(self.ranks[k][block]) + int(np.bitwise_count(inside).sum()) + rest.bit_count()

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.width):
            bit, ones = self._bit(k, i), self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _span(self, token: int, end: int) -> tuple[int, int]:
        """On the last plane: where the token's ids start and where those before ``end`` stop."""
        if token < 0 or token >> self.width:
            return 0, 0
        start = 0
        for k in range(self.width):
            a, b = self._ones(k, start), self._ones(k, end)
            if token >> (self.width - 1 - k) & 1:
                start, end = self.zeros[k] + a, self.zeros[k] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, end: int | None = None) -> int:
        """How often ``token`` stands before position ``end`` (all positions if None)."""
        a, b = self._span(token, self.n if end is None else min(max(end, 0), self.n))
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``token``; -1 if there are fewer."""
        start, end = self._span(token, self.n)
        if not 0 <= k < end - start:
            return -1
        at = start + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _select_bit(self, k: int, bit: int, nth: int) -> int:
        before = self.ranks[k].astype(np.int64)
        if not bit:
            before = np.arange(before.size) * BLOCK - before
        block = int(np.searchsorted(before, nth, side="right")) - 1
        first = block * (BLOCK // 8)
        bits = np.unpackbits(self.planes[k][first:first + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[nth - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        row = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level, k in enumerate(range(self.width - 1, -1, -1)):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(row)
            up[~bit] = row[:self.zeros[k]]
            up[bit] = row[self.zeros[k]:] | row.dtype.type(1 << level)
            row = up
        return row


def pack_shard(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """One shard file: documents (null ids allowed) and the wavelet matrix of their ids."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    body = b"".join([known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                     np.array(counts, "<u4").tobytes(), WaveletMatrix.build(ids).to_bytes()])
    return HEAD.pack(MAGIC, 0, len(doc_ids), len(ids)) + zstandard.ZstdCompressor(level=1).compress(body)


def open_shard(blob: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Documents, their id counts and the wavelet matrix of a shard file."""
    magic, _, n_docs, _ = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    body = zstandard.ZstdDecompressor().decompress(blob[HEAD.size:])
    known = np.frombuffer(body, np.uint8, n_docs)
    numbers = np.frombuffer(body, "<i8", n_docs, n_docs).tolist()
    counts = np.frombuffer(body, "<u4", n_docs, 9 * n_docs)
    return ([d if k else None for d, k in zip(numbers, known)], counts,
            WaveletMatrix.from_bytes(memoryview(body)[13 * n_docs:]))


class Encoder:
    """Ids of texts by the tokenizers library, which encodes each distinct piece once (bounded caches).

    New pieces are encoded as one text with blanks between them; a piece's last id is the one whose token
    carries the end-of-word mark.  They are normalised and split already, so the tokenizer that encodes them only
    cuts at blanks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(word_bpe.END)]] = True
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.held = self.pieces_held = 0  # characters of all chunks, and of all pieces, in the caches

    def _learn(self, chunks: set[str]) -> None:
        """Put the ids of ``chunks`` into the cache, which afterwards holds all of them."""
        new_chunks = chunks.difference(self.chunks)
        size = sum(map(len, new_chunks))
        if len(self.chunks) + len(new_chunks) > CACHE_ENTRIES or self.held + size > CACHE_CHARS:
            self.chunks.clear()
            new_chunks, size, self.held = chunks, sum(map(len, chunks)), 0
        if len(self.pieces) > CACHE_ENTRIES or self.pieces_held > CACHE_CHARS:
            self.pieces.clear()
            self.pieces_held = 0
        self.held += size
        odd = {c for c in new_chunks if not c.isprintable() and not word_bpe.is_known(c)}
        for c in odd:
            self.chunks[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, np.uint32).tobytes()
        new_chunks = new_chunks - odd
        words = [c for c in new_chunks if c.isalpha()]
        cut = [(c, word_bpe.SPLIT.findall(c)) for c in new_chunks.difference(words)]
        new = list(set(words).union(*(ps for _, ps in cut)).difference(self.pieces))
        if new:
            self.pieces_held += sum(map(len, new))
            ids = np.array(self.merger.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
            blob, last = ids.tobytes(), (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(last) != len(new):
                raise ValueError("a piece was encoded as several")
            ends = last.tolist()
            self.pieces.update(zip(new, map(blob.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        known = self.pieces.__getitem__
        self.chunks.update(zip(words, map(known, words)))
        self.chunks.update((c, b"".join(map(known, ps))) for c, ps in cut)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [t.lower().split() if word_bpe.is_plain(t) else None for t in texts]
        self._learn(set().union(*filter(None, cut)))
        get = self.chunks.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() if w is None
                else b"".join(map(get, w)) for t, w in zip(texts, cut)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SHARD_COLUMNS = "part int, nth int, n_docs long, n_ids long, payload binary"


def write_shards(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID,
                 shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` in ascending ``doc_id`` order into shard files under ``target``.

    Rows are range-partitioned by ``doc_id`` (null first), rows of one id by a hash of the text and copies of one row by
    where they were read, so neither a repeated id nor a repeated row lies in one task; a partition streams its documents into shards of about ``shard_ids`` ids, so a task
    holds one shard at a time.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    tail = np.array([end_id], np.uint32).tobytes()

    def shards(batches):
        from pyspark import TaskContext

        encoder, part, nth = _encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, counts, ids = [], [], []

        def close():
            flat = np.frombuffer(b"".join(ids), np.uint32)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()),
                "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([flat.size], pa.int64()),
                "payload": pa.array([pack_shard(doc_ids, counts, flat)], pa.binary())})

        held = 0
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                for d, x in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch))):
                    doc_ids.append(d)
                    ids.append(x + tail)
                    counts.append(len(ids[-1]) // 4)
                    held += counts[-1]
                    if held >= shard_ids:
                        yield close()
                        doc_ids, counts, ids, held, nth = [], [], [], 0, nth + 1
        if doc_ids:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("of_text").asc(), F.col("copy").asc()]
    rows = id_text(docs).withColumn("of_text", F.xxhash64("text")).withColumn("copy", F.spark_partition_id())
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(shards, SHARD_COLUMNS).write.parquet(target, compression="none"))


def read_shards(docs: DataFrame, source: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard_part, shard_nth`` of every document in the files.

    ``start`` counts the ids of all documents before it: per-partition totals (as many rows as files) are
    summed in order, then a partition's shards, then the documents inside a shard.
    """
    spark = docs.sparkSession
    files = spark.read.schema(SHARD_COLUMNS).parquet(source)
    heads = files.select("part", "nth", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (heads.withColumn("inner_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
              .select("part", "nth", (F.col("part_start") + F.col("inner_start")).alias("first")))

    def documents(batches):
        for batch in batches:
            for part, nth, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "nth", "payload"))):
                doc_ids, counts, matrix = open_shard(blob)
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                raw = ids.tobytes()
                n = len(doc_ids)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()), "part": pa.array([part] * n, pa.int32()),
                    "nth": pa.array([nth] * n, pa.int32()), "offset": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())})

    rows = files.select("part", "nth", "payload").mapInArrow(
        documents, "doc_id long, part int, nth int, offset long, n_tokens long, ids_crc32 long")
    return (rows.join(firsts, ["part", "nth"])
            .select("doc_id", (F.col("first") + F.col("offset")).cast("long").alias("start"), "n_tokens", "ids_crc32",
                    F.col("part").alias("shard_part"), F.col("nth").alias("shard_nth")))


def token_files(docs: DataFrame, target: str | None = None, path: str | None = None) -> DataFrame:
    """Write the shard files of ``docs`` (under the shared scratch folder unless ``target`` is given) and
    return :func:`read_shards` of them.

    A null text is an empty one: its only id is the end id.  Repeated rows are all written.  Other columns
    are ignored.  An empty table writes no shard and gives an empty result.
    """
    target = target or fresh_path(docs.sparkSession, "token-shards")
    write_shards(docs, target, path)
    return read_shards(docs, target)
