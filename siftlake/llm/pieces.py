"""Cutting a text into pieces that byte-level BPE encodes independently of each other, and caching what they encode to."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash

#: The characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Every boundary of these pieces is also one of public_tokenizers.PATTERN: all alternatives of that pattern other
#: than white space take a blank at their start only, so a run of other characters with the blank before it is
#: matched without regard to what surrounds it, and runs of white space are cut by the same two alternatives here.
PIECE = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")


#: White space other than blanks and line ends, that of ASCII first.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{WHITE_SPACE}]", c) and c not in " \n"]


def spaced(text: str) -> str | None:
    """The text with its words one blank apart, for texts whose only white space is single blanks and single line ends
    between words.

    Each word stands for itself with a blank before it, or, if it starts with a line end, for a line end and a word
    without a blank; the first word starts with a line end that the text does not have. Their pieces follow each other as in
    the text, since a piece ends before each blank and on both sides of a single line end. None for other texts.
    """
    if not text or text[0] in " \n" or text[-1] in " \n":
        return None
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return None
    for c in _OTHER_SPACE[:4] if text.isascii() else _OTHER_SPACE:
        if c in text:
            return None
    return "\n" + text.replace("\n", " \n")


class PieceCache(dict):
    """piece -> value. fill() computes the values of the pieces that a block of texts adds, all in one call."""

    def __init__(self, encode: Callable[[list[str]], list], max_pieces: int = 250_000):
        super().__init__()
        self.encode = encode
        self.max_pieces = max_pieces

    def fill(self, texts: list[str]) -> list[list[str]]:
        """The texts' pieces, with all of them in the cache. A full cache is emptied first, so memory is bounded by
        max_pieces and one block."""
        if len(self) > self.max_pieces:
            self.clear()
        cut = [PIECE.findall(t) for t in texts]
        new = list(set().union(*cut).difference(self))
        if new:
            self.update(zip(new, self.encode(new), strict=True))
        return cut


def blocks(lengths: list[int], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with at most `most` characters together (a longer row is a range of its own)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts; null reads as the empty string."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash, emptied when it is full."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


word_hashes = WordHashes()
#: What a worker process caches between batches. Workers outlive their tasks, so `task` empties it.
caches: list[dict] = [word_hashes]


def task(run: Callable) -> Callable:
    """A mapInArrow function after which the process' caches are empty and free memory is the system's again."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not with this C library
                pass

    return wrapped
