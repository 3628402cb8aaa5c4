"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per UTF-8 byte.  Its symbols form a doubly linked list and a heap
holds the ranks of adjacent pairs; the lowest-rank pair is popped and merged until none is left.
The word's count is its initial symbols minus the merges done: no token id is ever made.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import word_bpe
from tidemark.llm.common import WordCache, id_text, texts_of, tokenizer_path

#: A document with more tokens is over the limit (parameter of :func:`token_counts`).
CONTEXT_TOKENS = 2048


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges: ``len(symbols)`` minus the number of merges."""
    n = len(symbols)
    if n < 2:
        return n
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1)
            if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:  # one of the two has been merged since
            continue
        merges += 1
        symbols[i], symbols[j] = a + b, None
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        h = left[i]
        if h >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return n - merges


class TokenCounter:
    """Counts a text's tokens as the library does, without ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.ranks = word_bpe.load_ranks(path)
        self.bytes = word_bpe.byte_symbols()
        self.pieces = WordCache(self._piece)
        self.chunks = WordCache(self._chunk)

    def _piece(self, piece: str) -> int:
        symbols = [self.bytes[b] for b in piece.encode()]
        symbols[-1] += word_bpe.END
        return merged_count(symbols, self.ranks)

    def _chunk(self, chunk: str) -> int:
        if not word_bpe.is_known(chunk):
            # the library's split gives each piece as its bytes' symbols
            pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))
            return sum(merged_count([*p[:-1], p[-1] + word_bpe.END], self.ranks) for p, _ in pieces)
        if chunk.isalpha():
            return self.pieces[chunk]
        return sum(map(self.pieces.__getitem__, word_bpe.SPLIT.findall(chunk)))

    def _plain(self, text: str) -> int:
        return sum(map(self.chunks.__getitem__, text.split()))

    def count(self, text: str) -> int:
        if word_bpe.is_plain(text):
            return self._plain(text.lower())
        total = 0
        for part in word_bpe.regex.split("|".join(map(word_bpe.regex.escape, word_bpe.SPECIALS)), text):
            # rejoining on blanks keeps U+001C-1F inside their chunk
            normal = self.normalizer.normalize_str(part) if part else ""
            total += sum(self._chunk(x) for x in normal.split(" ") if x)
        return total + sum(text.count(s) for s in word_bpe.SPECIALS)


_counters: dict[str, TokenCounter] = {}


def _counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = CONTEXT_TOKENS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, one row per input row.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; other
    columns are ignored; an empty table gives an empty result.  Rows do not move: the counting
    is one pass over the scan's own partitions.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def count(batches):
        counter = _counter(path)
        for batch in batches:
            counts = [counter.count(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64()),
                 pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return id_text(docs).select("doc_id", "text", n_bytes).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
