"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of the corpus lie in one flat symbol array. An inverted index maps each mergeable
pair, by its rank, to the positions where it starts. Merges are applied in rank order, each to all positions of its
list at once, and only the pairs next to a merged position are looked up again. Words are what
public_tokenizers.PATTERN matches; a task caches their ids, so the many repetitions of a word cost one dictionary
look-up each. Nothing is shuffled: each task replays the words of its own rows, block by block. (One vocabulary for
the whole corpus would have to come back to every occurrence of its words by a shuffle of all of them, or by a
broadcast without a bound.) Decoding reads a document's ids alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from siftlake.llm.pieces import PieceCache, blocks, caches, task, texts_of
from siftlake.storage import read_table, ship_package

RANK_FILE = "byte_bpe_50k.tiktoken"


class MergeReplay:
    """Encodes words by a rank file (lines of base64 token and rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(self.ranks.values()) + 1
        self.none = size
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.flat_tokens = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_sizes = np.fromiter(map(len, self.tokens), np.int64, size)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(merged, dtype=np.int64)[order], self.none)
        pairs = self.byte_ids[:, None] * size + self.byte_ids[None, :]
        at = np.searchsorted(self.pair_keys, pairs)
        self.byte_pairs = np.where(self.pair_keys[at] == pairs, self.pair_ranks[at], self.none)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what adjacent tokens merge to; self.none where they do not."""
        keys = left * self.none + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.none)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (no empty words)."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        word_of = np.repeat(np.arange(len(words)), lengths)
        symbols, odd = self._replay(flat, ends, word_of)
        alive = symbols >= 0
        ids = symbols[alive].astype(np.uint32)
        cuts = np.cumsum(np.bincount(word_of[alive], minlength=len(words)))[:-1]
        found = np.split(ids, cuts)
        for w in odd:
            found[w] = np.array(self.encode_alone(words[w]), dtype=np.uint32)
        return found

    def _replay(self, flat: np.ndarray, ends: np.ndarray, word_of: np.ndarray) -> tuple[np.ndarray, list[int]]:
        n, none = len(flat), self.none
        symbol = self.byte_ids[flat]
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[0] = -1
        before[ends[:-1]] = -1
        rank = np.full(n, none, dtype=np.int64)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.byte_pairs[flat[inner], flat[inner + 1]]
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(positions: np.ndarray, ranks: np.ndarray) -> None:
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            starts = np.flatnonzero(np.diff(ranks, prepend=-1))
            stops = np.append(starts[1:], len(ranks))
            for r, a, b in zip(ranks[starts].tolist(), starts.tolist(), stops.tolist(), strict=True):
                if r in index:
                    index[r].append(positions[a:b])
                else:
                    index[r] = [positions[a:b]]
                    heapq.heappush(heap, r)

        pairs = inner[rank[inner] < none]
        post(pairs, rank[pairs])
        odd: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(index.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            follow = after[at]
            if len(at) > 1:
                chained = np.append(False, follow[:-1] == at[1:])
                if chained.any():  # overlapping occurrences, as in a run of one letter: every other one merges
                    here = np.arange(len(at))
                    first = np.maximum.accumulate(np.where(chained, 0, here))
                    merges = (here - first) % 2 == 0
                    at, follow = at[merges], follow[merges]
            beyond = after[follow]
            symbol[at] = r
            symbol[follow] = -1
            rank[follow] = none
            rank[at] = none
            after[at] = beyond
            right = beyond >= 0
            before[beyond[right]] = at[right]
            left = before[at]
            touched = np.concatenate([at[right], left[left >= 0]])
            if not len(touched):
                continue
            new = self.pair_rank(symbol[touched], symbol[after[touched]])
            rank[touched] = new
            mergeable = new < none
            touched, new = touched[mergeable], new[mergeable]
            if len(new):
                if new.min() < r:  # a pair that should have come earlier: the order within such a word is replayed alone
                    odd.update(word_of[touched[new < r]].tolist())
                post(touched, new)
        return symbol, sorted(odd)

    def encode_alone(self, word: bytes) -> list[int]:
        """One word by repeated merging of its leftmost pair of least rank."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, self.none) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == self.none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a stream of ids."""
        sizes = self.token_sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat_tokens[np.repeat(self.token_starts[ids] - ends + sizes, sizes) + np.arange(sizes.sum())].tobytes()


class Codec:
    """Texts to ids and back, with a cache over pieces of texts."""

    def __init__(self, path: str):
        self.replay = MergeReplay(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces = PieceCache(self._encode_pieces)

    def _encode_pieces(self, pieces: list[str]) -> list[tuple[bytes, str]]:
        """For each piece: ids as little-endian 32-bit integers, ids in decimal."""
        cut = [[m.encode() for m in self.pattern.findall(p)] for p in pieces]
        words = list({w for ws in cut for w in ws})
        coded = {}
        for w, ids in zip(words, self.replay.encode_words(words), strict=True):
            coded[w] = (ids.astype("<u4").tobytes(), " ".join(map(str, ids.tolist())))
        out = []
        for ws in cut:
            if len(ws) == 1:
                out.append(coded[ws[0]])
            else:
                a, b = zip(*[coded[w] for w in ws], strict=True)
                out.append((b"".join(a), " ".join(b)))
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Per text: ids, ids in decimal joined by blanks."""
        for a, b in blocks([len(t) for t in texts]):
            for pieces in self.pieces.fill(texts[a:b]):
                coded = list(map(self.pieces.__getitem__, pieces))
                yield np.frombuffer(b"".join([c[0] for c in coded]), "<u4"), " ".join([c[1] for c in coded])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
        caches.append(_codecs[path].pieces)
    return _codecs[path]


def encode_documents(docs: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """doc_id, ids (array of int) of every row's whole text. Null and empty texts have no ids.

    Rows are independent of each other: nulls and repeated ids in doc_id pass through, other columns are not read.
    """
    ship_package(docs.sparkSession)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(public_tokenizers.path(rank_file))
        for batch in batches:
            ids = [ids.astype(np.int32) for ids, _ in own.encode(texts_of(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """doc_id, text from doc_id, ids. Bytes that are no UTF-8 become replacement characters."""
    ship_package(encoded.sparkSession)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = codec(public_tokenizers.path(rank_file)).replay
        for batch in batches:
            texts = [replay.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digest_documents(docs: DataFrame, rank_file: str = RANK_FILE, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of a whole text's ids and of the bytes these decode to.

    with_ids adds the ids (array of int). Null and empty texts have no ids; a text of any length is encoded whole.
    Rows are independent of each other, so nulls and repeats pass through; other columns are not read.
    """
    ship_package(docs.sparkSession)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(public_tokenizers.path(rank_file))
        for batch in batches:
            counts, ids_sha, decoded_sha, streams = [], [], [], []
            for ids, decimal in own.encode(texts_of(batch)):
                if with_ids:
                    streams.append(ids.astype(np.int32))
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(own.replay.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            columns += [pa.array(streams, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoded bytes."""
    return digest_documents(read_table(spark, sf_dir, "documents"))
