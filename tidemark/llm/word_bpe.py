"""Splitting of texts for the word-level byte-pair vocabulary (``word_bpe_49k.json``).

The file's normaliser (NFC, white space to one blank, lower case) and its split pattern
never join characters across white space.  A text is therefore lower-cased and cut at
white space, and each distinct chunk is split and merged once per worker (bounded cache).
Texts where that shortcut could differ from the library (special-token strings, text that is
not NFC, capital sigma, the separators U+001C-1F) are handed to the library's own
normaliser as a whole, and chunks with characters that this Python's Unicode tables do not know
(the library's are others) to its normaliser and split.
"""

from __future__ import annotations

import json
import unicodedata

import regex

#: Fixed by the vocabulary file: split pattern and special tokens.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
ODD = ("<|startoftext|>", "<|endoftext|>", "Σ", "\x1c", "\x1d", "\x1e", "\x1f")
END = "</w>"


def is_plain(text: str) -> bool:
    """Whether lower-casing and cutting at white space equals the library's own treatment."""
    for odd in ODD:
        if odd in text:
            return False
    return text.isascii() or unicodedata.is_normalized("NFC", text)


def is_known(chunk: str) -> bool:
    """Whether Python's Unicode tables know all characters (an unassigned one is not printable)."""
    return chunk.isprintable() or all(unicodedata.category(c) != "Cn" for c in chunk)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: a printable Latin-1 byte stands for
    itself, the others take the code points from 256 on, in order."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)}


def load_ranks(path: str) -> dict[tuple[str, str], int]:
    """Adjacent pair -> rank, from the vocabulary file."""
    with open(path, encoding="utf-8") as f:
        return {(a, b): i for i, (a, b) in enumerate(json.load(f)["model"]["merges"])}
