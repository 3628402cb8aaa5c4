"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A copy scores at least :data:`MIN_SCORE` of the test item's own alignment score, and at least that of three words.
Two matched words that follow each other in such an alignment are a *step*; it costs nothing, one (a word replaced, put
in or left out between them) or more.  A score of ``T`` leaves room for so few costly steps that at least ``T / 2 - 1``
cost one at most, each from another word of the item.  So an item's n-grams are its word pairs, next to each other or
one word apart, and of its ``m - 1`` places all but ``ceil(T / 2) - 1`` are seeds, those rarest in the corpus (counts over
all documents): every copy holds a seed, and no copy is lost.  A document's words around a seed are aligned with the
item if they hold enough of the item's pairs.

The test items are sent to the tasks in blocks of bounded size, one block at a time; each block passes over the documents,
its hits are written to the shared folder, and its memory is given back.  Documents never move.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, stored, texts_of

#: Smith-Waterman: match, mismatch, gap; and the least share of an item's own score that counts as a copy.
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
MIN_SCORE = 0.5
#: Words whose score a copy reaches at least; items with fewer words match only documents that are no longer than themselves.
MIN_WORDS = 3
#: Bytes of test items sent to the tasks at a time.
BLOCK_BYTES = 8_000_000
WORD = re.compile(r"\w+")
#: Cells of one alignment array, and words looked at together; longer texts are cut into overlapping pieces.
CELLS = 2_000_000
GROUP_WORDS = 200_000
HITS = "doc_id long, item_id long, score double, first_word long, last_word long, digest string"


def least_score(m: np.ndarray) -> np.ndarray:
    """Score, of ``2 * m``, that a copy of an item of ``m`` words reaches at least."""
    return np.maximum(np.ceil(MIN_SCORE * MATCH * m), MATCH * MIN_WORDS).astype(np.int64)


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers ``first[k] .. first[k] + count[k] - 1`` of all ``k`` in turn, and each one's ``k``."""
    owner = np.repeat(np.arange(len(count)), count)
    return first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner], owner


class ItemBlock:
    """Test items as word-id arrays, and their word pairs."""

    def __init__(self, items: list[tuple[int, str]]):
        vocabulary: dict[str, int] = {}
        self.items, self.item_ids, self.short = [], [], {}
        for item_id, text in items:
            words = WORD.findall((text or "").lower())
            if len(words) >= MIN_WORDS:
                self.items.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64))
                self.item_ids.append(item_id)
            elif words:
                self.short.setdefault(tuple(words), []).append(item_id)
        self.vocabulary, self.base = vocabulary, len(vocabulary) + 1
        self.length = np.array([len(x) for x in self.items], np.int64)
        self.least = least_score(self.length)
        parts = [x for item in self.items for x in (item, (0, 0))]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        near, far = self._pair(flat, 1), self._pair(flat, 2)
        self.pairs = np.unique(np.concatenate([near, far]))
        self.pairs = self.pairs[self.pairs > 0]
        at = np.cumsum(self.length + 2) - (self.length + 2)
        self.near_of, self.far_of = ([rows[a:a + n - 1] for a, n in zip(at.tolist(), self.length.tolist())]
                                     for rows in (self._rows(near), self._rows(far)))
        item = np.repeat(np.arange(len(self.items)), self.length - 1)
        held = [item * len(self.pairs) + np.concatenate(rows) for rows in (self.near_of, self.far_of)] if self.items else []
        known = [h[np.concatenate(rows) >= 0] for h, rows in zip(held, (self.near_of, self.far_of))]
        self.held = np.unique(np.concatenate(known)) if known else np.zeros(0, np.int64)

    def _pair(self, ids: np.ndarray, gap: int) -> np.ndarray:
        """Number of the pair that starts at each word and ends ``gap`` words on; 0 where a word is in no item."""
        out = np.zeros(len(ids), np.int64)
        a, b = ids[:-gap], ids[gap:]
        out[:len(a)] = np.where((a > 0) & (b > 0), a * self.base + b, 0)
        return out

    def _rows(self, pairs: np.ndarray) -> np.ndarray:
        """Row of each pair among the items' pairs; -1 where no item holds it."""
        out = np.full(len(pairs), -1, np.int64)
        at = np.flatnonzero(pairs)
        if at.size and self.pairs.size:
            row = np.minimum(np.searchsorted(self.pairs, pairs[at]), self.pairs.size - 1)
            out[at] = np.where(self.pairs[row] == pairs[at], row, -1)
        return out

    def groups(self, texts: list[str]):
        """Pieces of the texts, together about :data:`GROUP_WORDS` words: (text, first word, word ids).

        Pieces of one text overlap by more than an alignment's window."""
        get, overlap = self.vocabulary.get, int(4 * self.length.max(initial=1))
        long, group, size = max(GROUP_WORDS, 2 * overlap), [], 0
        for d, text in enumerate(texts):
            words = WORD.findall(text.lower())
            ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
            for first in range(0, max(1, len(ids) - overlap), long - overlap):
                group.append((d, first, ids[first:first + long]))
                size += len(group[-1][2])
                if size >= GROUP_WORDS:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def counts(self, texts: list[str]) -> np.ndarray:
        """How often each pair stands in the texts (a little more at the cuts of very long ones)."""
        total = np.zeros(len(self.pairs), np.int64)
        for group in self.groups(texts):
            flat = np.concatenate([x for _, _, ids in group for x in (ids, (0, 0))]).astype(np.int64)
            for gap in (1, 2):
                rows = self._rows(self._pair(flat, gap))
                total += np.bincount(rows[rows >= 0], minlength=len(total))
        return total

    def keep_seeds(self, counts: np.ndarray) -> None:
        """Choose each item's seed places by the counts of the two pairs that start there."""
        rows, items, places = [], [], []
        for item, (near, far) in enumerate(zip(self.near_of, self.far_of)):
            common = counts[near] + np.where(far >= 0, counts[far], 0)
            chosen = np.argsort(common, kind="stable")[:self.length[item] - (self.least[item] + 1) // 2 + 1]
            for r in (near[chosen], far[chosen]):
                rows.append(r[r >= 0])
                places.append(chosen[r >= 0])
                items.append(np.full(len(rows[-1]), item))
        rows, items, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, items, places))
        order = np.argsort(rows, kind="stable")
        self.seed_item, self.seed_place = items[order], places[order]
        self.seeds_to = np.cumsum(np.bincount(rows, minlength=len(self.pairs)))

    def hits(self, texts: list[str]) -> list[list[tuple[int, float, int, int]]]:
        """For each text: (item id, score, first word, last word) of each item that it holds a copy of, best place."""
        found: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        if self.items:
            for group in self.groups(texts):
                for piece, item, score, first, last in self._aligned([ids for _, _, ids in group]):
                    d, offset, _ = group[piece]
                    if score > found[d].get(item, (0.0,))[0]:
                        found[d][item] = (score, offset + first, offset + last)
        out = [[(self.item_ids[i], *x) for i, x in sorted(f.items())] for f in found]
        for d, text in enumerate(texts if self.short else []):
            words = tuple(w.group() for w in islice(WORD.finditer(text.lower()), MIN_WORDS))
            out[d] += [(i, 1.0, 0, len(words) - 1) for i in self.short.get(words, ())]
        return out

    def _windows(self, pieces: list[np.ndarray], near: np.ndarray, far: np.ndarray, begins: np.ndarray):
        """Item, piece, and first and last place of the windows around seeds, each once."""
        size = np.diff(np.append(0, self.seeds_to))
        lengths = np.array([len(p) for p in pieces])
        spread = int(lengths.max()) + 4 * int(self.length.max()) + 8
        keys = []
        for rows in (near, far):
            at = np.flatnonzero(rows >= 0)
            at = at[size[rows[at]] > 0]
            if not at.size:
                continue
            count = size[rows[at]]
            for part in np.split(np.arange(at.size), np.flatnonzero(np.diff(np.cumsum(count) // CELLS)) + 1):
                post, owner = expand(self.seeds_to[rows[at[part]]] - count[part], count[part])
                where, item = at[part][owner], self.seed_item[post]
                piece = np.searchsorted(begins, where, "right") - 1
                step = self.length[item] // 2 + 1
                block = (where - begins[piece] - self.seed_place[post]) // step + 2
                keys.append(np.unique((item * len(pieces) + piece) * spread + block))
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        item, piece = np.divmod(key // spread, len(pieces))
        step, pad = self.length[item] // 2 + 1, 2 * self.length[item] - self.least[item]
        low = (key % spread - 2) * step - pad
        high = np.minimum(low + step + self.length[item] + 2 * pad, lengths[piece])
        return item, piece, begins[piece] + np.maximum(low, 0), begins[piece] + high

    def _aligned(self, pieces: list[np.ndarray]):
        """(piece, item, score, first word, last word) of the windows that hold a copy."""
        flat = np.concatenate([x for ids in pieces for x in (ids, (0, 0))]).astype(np.int64)
        lengths = np.array([len(p) + 2 for p in pieces])
        begins = np.cumsum(lengths) - lengths
        near, far = self._rows(self._pair(flat, 1)), self._rows(self._pair(flat, 2))
        item, piece, low, high = self._windows(pieces, near, far, begins)
        # a copy's steps start at so many words of the window: first by pairs of any item, then by this item's own
        need = (self.least[item] + 1) // 2 - 1
        any_pair = np.append(0, np.cumsum((near >= 0) | (far >= 0)))
        enough = any_pair[high] - any_pair[low] >= need
        item, piece, low, high, need = (x[enough] for x in (item, piece, low, high, need))
        keep = np.zeros(len(item), bool)
        for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(np.cumsum(high - low) // CELLS)) + 1):
            at, owner = expand(low[part], (high - low)[part])
            own = np.zeros(len(at), bool)
            for rows in (near[at], far[at]):
                k = np.flatnonzero(rows >= 0)
                wanted = item[part][owner[k]] * len(self.pairs) + rows[k]
                own[k] |= self.held[np.minimum(np.searchsorted(self.held, wanted), self.held.size - 1)] == wanted
            keep[part] = np.bincount(owner[own], minlength=len(part)) >= need[part]
        item, piece, low, high = (x[keep] for x in (item, piece, low, high))
        for i in np.unique(item).tolist():
            mine, words = np.flatnonzero(item == i), self.items[i]
            width = int((high - low)[mine].max())
            for part in np.array_split(mine, -(-len(mine) * (width + 1) // CELLS)):
                at = low[part, None] + np.arange(width)
                text = np.where(at < high[part, None], flat[np.minimum(at, len(flat) - 1)], 0)
                score, end = smith_waterman(words, text)
                good = np.flatnonzero(score >= self.least[i])
                back = np.zeros((len(good), width), np.int64)  # from the end backwards, for the first word
                for r, g in enumerate(good.tolist()):
                    back[r, :end[g] + 1] = text[g, end[g]::-1]
                _, length = smith_waterman(words[::-1], back)
                for g, n in zip(good.tolist(), length.tolist()):
                    last = int(low[part[g]] - begins[piece[part[g]]] + end[g])
                    yield int(piece[part[g]]), i, float(score[g] / (MATCH * len(words))), last - n, last


def smith_waterman(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of ``item`` with each row of ``texts``, and the word at which it ends.

    A row of the table at a time, all texts together; a gap along the row is a running maximum.  Word id 0 matches nothing."""
    n, width = texts.shape
    row, slope = np.zeros((n, width + 1)), -GAP * np.arange(width + 1)
    best, end = np.zeros(n), np.zeros(n, np.int64)
    for w in item:
        step = np.where(texts == w, MATCH, MISMATCH) if w > 0 else np.full((n, width), MISMATCH)
        new = np.maximum(row + GAP, 0.0)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + step)
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top - 1, end)
    return best, end


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Blocks of test items, each of bounded size; the rows stream to the driver a partition at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where(F.col("text").isNotNull()).dropDuplicates().orderBy("item_id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"]) + 8
        if size >= block_bytes:
            yield ItemBlock(block)
            block, size = [], 0
    if block:
        yield ItemBlock(block)


def pair_counts(docs: DataFrame, block: ItemBlock) -> np.ndarray:
    """How often each of the block's pairs stands in ``docs``: one number per pair reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        total = np.zeros(len(shared.value.pairs), np.int64)
        for batch in batches:
            total += shared.value.counts(texts_of(batch))
        rows = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"row": pa.array(rows), "n": pa.array(total[rows])})

    out = np.zeros(len(block.pairs), np.int64)
    for r in id_text(docs).select("text").mapInArrow(count, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).collect():
        out[r["row"]] = r["n"]
    shared.unpersist()
    return out


def block_hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """:data:`HITS` of all blocks, ``digest`` being the text's SHA-256; one block is alive at a time."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], HITS)
    names = out.columns
    for block in item_blocks(benchmark, block_bytes):
        block.keep_seeds(pair_counts(docs, block))
        shared = spark.sparkContext.broadcast(block)

        def hits(batches, shared=shared):
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            for batch in batches:
                texts = texts_of(batch)
                rows = [(d, *h, hashlib.sha256(t.encode()).hexdigest())
                        for d, t, found in zip(batch.column("doc_id").to_pylist(), texts, shared.value.hits(texts)) for h in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        out = out.unionByName(stored(id_text(docs).mapInArrow(hits, HITS), "hits"))
        shared.unpersist()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word``: a row for each document and test item it holds a copy of.

    Null and empty texts hold nothing; items without a word match nothing, items of one or two words only documents
    that are no more than them; repeated documents are reported each, repeated items once; of equally good
    places the first counts; texts of any length are searched whole; a null ``doc_id`` stays null; other columns are
    ignored; an empty table on either side gives an empty result.
    """
    return block_hits(docs, benchmark, block_bytes).drop("digest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a copy of a test item; columns and other rows stay as they are.

    What a copy is, and odd input, as in :func:`contaminated`; rows of a null or repeated ``doc_id`` are told apart by
    their text.  The digests of the texts that go are joined back; a small table of them is broadcast by its
    stored size, a larger one is shuffled."""
    gone = block_hits(docs, benchmark, block_bytes).select("digest").distinct()
    return docs.join(gone, F.sha2(docs["text"].cast("string").cast("binary"), 256) == gone["digest"], "left_anti")
