"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their scores come from a ``.model`` file.  A text's best segmentation maximises
the sum of piece scores.  No piece holds a white-space marker after another character, so a
piece ends wherever a marker follows another character, and the segmentation of a text is that
of its chunks (a run of markers and what follows it).  A batch's new chunks are segmented
together: those of one length advance through the trie as one numpy array.  A character that
is no piece is written as byte pieces.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, texts_of, tokenizer_path

MARK = "▁"
#: An unknown character scores this much below the lowest piece, as in the library's unigram model.
UNKNOWN_PENALTY = 10.0
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Cells of one Viterbi array; longer groups of chunks are cut.
CELLS = 1_000_000
#: Documents encoded at a time.
BATCH = 600
#: Chunks whose ids a worker keeps; the cache is emptied when it holds more.
KEPT_CHUNKS = 150_000


class DoubleArray:
    """Double-array trie: the child of node ``s`` by code ``c`` is ``t = base[s] + c`` if ``check[t] == s``."""

    def __init__(self, keys: list[tuple[int, ...]]):
        tree: dict = {}
        for value, key in enumerate(keys):
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        top = max((c for k in keys for c in k), default=0)
        size = 4 * sum(map(len, keys)) + 2 * top + 4096
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = 0
        taken, queue = np.zeros(2 * size, bool), [(0, tree)]
        taken[0] = True
        front = [1] * 9  # where nodes of 0, 1, .. 8 or more children last found room: the search starts there
        for state, node in queue:  # grows while it is read: breadth first
            if -1 in node:
                self.value[state] = node[-1]
            codes = np.array(sorted(c for c in node if c >= 0), np.int64)
            if not codes.size:
                continue
            many = min(8, codes.size)
            start = max(front[many], int(codes[0]) + 1)
            while True:  # the first base at which every child's place is free, a stretch of slots at a time
                slots = start + np.flatnonzero(~taken[start:start + 256])
                fits = ~taken[(slots - codes[0])[:, None] + codes].any(axis=1)
                if fits.any():
                    b = int(slots[fits.argmax()] - codes[0])
                    break
                start += 256
            front[many:] = [max(f, start) for f in front[many:]]
            self.base[state] = b
            taken[b + codes] = True
            self.check[b + codes] = state
            queue.extend((b + int(c), node[int(c)]) for c in codes)
        used = int(np.flatnonzero(taken)[-1]) + top + 2
        self.base, self.check, self.value = self.base[:used], self.check[:used], self.value[:used]


class PieceModel:
    """The pieces of a ``.model`` file, ready to encode; sent to the tasks once (bounded by the file)."""

    def __init__(self, path: str | None = None, pieces: list[tuple[str, float]] | None = None):
        """``pieces``: (piece, score) in id order instead of a file; ``<0xHH>`` pieces are bytes."""
        skip: set[int] = set()
        if pieces is None:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            n = sp.get_piece_size()
            pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
            skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.pieces = [p for p, _ in pieces]
        self.byte_ids = np.full(256, -1, np.int32)
        for i, p in enumerate(self.pieces):
            if re.fullmatch(r"<0x[0-9A-F]{2}>", p):
                self.byte_ids[int(p[3:5], 16)] = i
                skip.add(i)
        self.ids = np.array([i for i in range(len(pieces)) if i not in skip], np.int32)
        letters = sorted({c for i in self.ids for c in self.pieces[i]})
        self.code_of = np.zeros(0x110000, np.int32)  # 0: no piece holds the character
        self.code_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.trie = DoubleArray([tuple(int(self.code_of[ord(c)]) for c in self.pieces[i]) for i in self.ids])
        self.scores = np.array([pieces[i][1] for i in self.ids], np.float64)
        self.unknown = float(self.scores.min(initial=0.0)) - UNKNOWN_PENALTY
        self.longest = max((len(self.pieces[i]) for i in self.ids), default=1)
        self.cache: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def _viterbi(self, chunks: list[str]) -> None:
        """Segment chunks of one length together and keep their ids (int32 bytes) in the cache."""
        width, n = len(chunks[0]) + 1, len(chunks)
        points = np.frombuffer("".join(MARK + x for x in chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code_of[points].reshape(n, width)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        origin, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            live, state = np.arange(n), np.zeros(n, np.int32)
            for j in range(i, min(width, i + self.longest)):
                c = code[live, j]
                step = base[state] + c
                ok = (c > 0) & (check[step] == state)
                live, state = live[ok], step[ok]
                at = value[state]
                leaf = at >= 0
                if j == i and np.count_nonzero(leaf) < n:  # a character that is no piece costs the unknown score
                    known = np.zeros(n, bool)
                    known[live[leaf]] = True
                    self._better(best, origin, piece, np.flatnonzero(~known), i, j, None)
                if not live.size:
                    break
                self._better(best, origin, piece, live[leaf], i, j, at[leaf])
        # the way back, all rows at once: ids fill each row from its right end
        ids, at, k, rows = np.zeros((n, width), np.int32), np.full(n, width), width, np.arange(n)
        count, strange = np.zeros(n, np.int32), np.zeros(n, bool)
        while rows.size:
            k -= 1
            p = piece[rows, at[rows]]
            ids[rows, k] = self.ids[p]
            strange[rows[p < 0]] = True
            count[rows] += 1
            at[rows] = origin[rows, at[rows]]
            rows = rows[at[rows] > 0]
        blob, size = ids.tobytes(), 4 * width
        for r, (chunk, m) in enumerate(zip(chunks, count.tolist())):
            self.cache[chunk] = blob[(r + 1) * size - 4 * m:(r + 1) * size]
        for r in np.flatnonzero(strange):
            self.cache[chunks[r]] = self._with_bytes(MARK + chunks[r], origin[r], piece[r])

    def _with_bytes(self, chunk: str, origin, piece) -> bytes:
        """Ids of a chunk some of whose characters are no pieces: their UTF-8 bytes as byte pieces."""
        out, at = [], len(chunk)
        while at > 0:
            start, p = int(origin[at]), int(piece[at])
            if p < 0:
                out.extend(self.byte_ids[b] for b in reversed(chunk[start:at].encode("utf-8", "replace")))
            else:
                out.append(self.ids[p])
            at = start
        return np.array(out[::-1], np.int32).tobytes()

    def _better(self, best, origin, piece, rows, i, j, at) -> None:
        score = best[rows, i] + (self.unknown if at is None else self.scores[at])
        wins = score > best[rows, j + 1]  # on a tie the earlier start, the longer piece, stays
        rows = rows[wins]
        best[rows, j + 1], origin[rows, j + 1] = score[wins], i
        piece[rows, j + 1] = -1 if at is None else at[wins]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text's chunks, each without the marker that it starts with."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in CHUNK.findall(MARK + text.replace(" ", MARK))]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32 bytes; an empty text has none."""
        cut = [self.chunks(t) for t in texts]
        if len(self.cache) > KEPT_CHUNKS:
            self.cache.clear()
        get = self.cache.get
        found = [list(map(get, x)) for x in cut]
        groups: dict[int, list[str]] = {}
        for c in {c for x, ids in zip(cut, found) if None in ids for c, y in zip(x, ids) if y is None}:
            groups.setdefault(len(c), []).append(c)
        for width, chunks in groups.items():
            step = max(1, CELLS // (width + 1))
            for k in range(0, len(chunks), step):
                self._viterbi(chunks[k:k + step])
        return [b"".join([y if y is not None else get(c) for c, y in zip(x, ids)] if None in ids else ids) for x, ids in zip(cut, found)]

    def decode(self, ids) -> str:
        """The text of the ids: pieces joined, byte pieces back to characters, markers to blanks,
        without the marker that encoding put in front."""
        out = bytearray()
        for i in ids:
            p = self.pieces[i]
            out += bytes([int(p[3:5], 16)]) if self.byte_ids[int(p[3:5], 16) if BYTE.fullmatch(p) else 0] == i else p.encode()
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


BYTE = re.compile(r"<0x[0-9A-F]{2}>")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, n_tokens, n_byte_tokens, ids_crc32, text, round_trip`` of every whole text.

    ``ids`` is the encoding, ``text`` its decoding, read back from the ids alone; ``round_trip``
    says that it equals the input (a marker character in the input comes back as a blank, and
    counts as equal to it).  Null text counts as empty: no ids, decoded to "".  Repeated rows
    are encoded each, other columns are ignored, an empty table gives an empty result.
    One pass over the scan's partitions; a worker keeps a bounded cache of chunks.
    """
    model = docs.sparkSession.sparkContext.broadcast(PieceModel(path or tokenizer_path("piece_bpe_32k.model")))

    def code(batches):
        m = model.value
        low, high = int(m.byte_ids.min()), int(m.byte_ids.max())
        plain = [p.replace(MARK, " ").encode() for p in m.pieces]
        for b in range(256):
            if m.byte_ids[b] >= 0:
                plain[m.byte_ids[b]] = bytes([b])
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                texts = texts_of(batch)
                coded = m.encode_batch(texts)
                lists = [np.frombuffer(x, np.int32) for x in coded]
                back, same = [], []
                for t, ids in zip(texts, lists):
                    decoded = b"".join(map(plain.__getitem__, ids.tolist())).decode("utf-8", "replace")
                    back.append(decoded[1:])
                    same.append(back[-1] == t or back[-1] == t.replace(MARK, " "))
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                bytes_of = [int(((x >= low) & (x <= high)).sum()) for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     pa.array([len(x) for x in lists], pa.int64()), pa.array(bytes_of, pa.int64()),
                     pa.array([zlib.crc32(x) for x in coded], pa.int64()), pa.array(back, pa.string()),
                     pa.array(same, pa.bool_())],
                    ["doc_id", "ids", "n_tokens", "n_byte_tokens", "ids_crc32", "text", "round_trip"])

    return id_text(docs).mapInArrow(code, "doc_id long, ids array<int>, n_tokens long, n_byte_tokens long, "
                                          "ids_crc32 long, text string, round_trip boolean")
