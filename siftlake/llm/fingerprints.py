"""Lempel-Ziv phrase fingerprints.

A document's UTF-8 bytes are parsed into LZ78 phrases (each the longest phrase seen before plus one byte). The set
of phrases is hashed into BINS bins; the signature holds each bin's least hash (one-permutation MinHash, empty bins
borrow from the next filled one). Two signatures agree in about the share of phrases that the documents have in
common, which is how much the one's dictionary helps to compress the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.llm.pieces import texts_of
from siftlake.storage import Workspace, read_table, ship_package

BINS = 128
#: The dictionary starts anew at so many phrases, which bounds its memory; the phrases stay in the set.
MAX_PHRASES = 1 << 18
_MASK = (1 << 61) - 1
_FACTOR = 0x5851F42D4C957F2D & _MASK


class Parser:
    """Incremental LZ78 parse. fork() gives a parser that goes on from the same state."""

    def __init__(self):
        self.trie: dict[int, int] = {}
        self.hashes = [1]
        self.old: list[list[int]] = []
        self.node = 0

    def feed(self, data: bytes) -> None:
        trie, hashes, node = self.trie, self.hashes, self.node
        get, append, n = trie.get, hashes.append, len(hashes)
        for c in data:
            key = node << 8 | c
            node = get(key, 0)
            if not node:
                trie[key] = n
                append((hashes[key >> 8] * _FACTOR + c + 1) & _MASK)
                n += 1
                if n > MAX_PHRASES:
                    self.old.append(hashes[1:])
                    trie.clear()
                    del hashes[1:]
                    n = 1
        self.node = node

    def fork(self) -> Parser:
        other = Parser()
        other.trie, other.hashes, other.old, other.node = dict(self.trie), list(self.hashes), list(self.old), self.node
        return other

    def signature(self) -> np.ndarray | None:
        """BINS numbers of 16 bits; None for an empty text. An unfinished last phrase counts as a phrase."""
        parts = [*self.old, self.hashes[1:]]
        if self.node:
            parts.append([self.hashes[self.node]])
        values = np.array([h for p in parts for h in p], dtype=np.uint64)
        if not len(values):
            return None
        values = _mix(values)
        least = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(least, (values >> np.uint64(57)).astype(np.int64), values)
        filled = np.flatnonzero(least != np.iinfo(np.uint64).max)
        at = np.searchsorted(filled, np.arange(BINS)) % len(filled)
        source = filled[at]
        distance = (source - np.arange(BINS)) % BINS
        return (_mix(least[source] + distance.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal bins, 0 to 1. Two empty texts are alike, an empty and another one are not."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.mean(a == b))


def as_text(signature: np.ndarray | None) -> str:
    return "" if signature is None else signature.astype(">u2").tobytes().hex()


def from_text(text: str) -> np.ndarray | None:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16) if text else None


def fingerprint(text: str) -> str:
    """The fingerprint of one text: 4 hex digits a bin; the empty string for the empty text."""
    parser = Parser()
    parser.feed(text.encode())
    return as_text(parser.signature())


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row's whole text (null: empty). Other columns are not read."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t) for t in texts_of(batch)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


class _Doc:
    """A document with the parser's state where its edited text departs from it."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.kept = len(text) - len(text) // 2
        self.halfway = Parser()
        self.halfway.feed(text[: self.kept].encode())
        whole = self.halfway.fork()
        whole.feed(text[self.kept :].encode())
        self.signature = whole.signature()

    def row(self, after: _Doc) -> dict:
        """The result row. The parser of the first half is used up."""
        edited = self.text[: self.kept] + after.text[: len(self.text) // 2]
        self.halfway.feed(edited[self.kept :].encode())
        other = self.halfway.signature()
        return {
            "doc_id": self.doc_id, "n_chars": len(self.text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
            "fingerprint": as_text(self.signature), "edited_fingerprint": as_text(other),
            "near_edited": likeness(self.signature, other), "near_next": likeness(self.signature, after.signature),
        }


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("doc_id", id_type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string()),
    ])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Rows are in ascending doc_id order; a null doc_id comes first and equal doc_ids are ordered by a hash of their
    texts. The last row's next one is the first; a table of one row has that row as its own next, an empty table gives an
    empty one. Null texts are empty, texts of any length are parsed whole, other columns are not read. The texts are shuffled once, by ranges of doc_id; the pairs that straddle two ranges, one per range, are
    made in a second, small step.
    """
    work = Workspace(docs.sparkSession, "fingerprints")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            schema = _schema(batch.schema.field(0).type)
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                doc = _Doc(doc_id, text)
                if held is None:
                    rows.append({"doc_id": doc_id, "text": text, "part": part, "edge": "first"})
                else:
                    rows.append(held.row(doc))
                held = doc
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if held is not None:
            last = {"doc_id": held.doc_id, "text": held.text, "part": part, "edge": "last"}
            yield pa.RecordBatch.from_pylist([last], schema=schema)

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    done = work.table(ordered.mapInArrow(run, f"doc_id {id_type}, {_RESULT}, part int, edge string, text string"), "ranges")

    firsts = done.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    lasts = done.filter("edge = 'last'").select("doc_id", "part", "text")
    # One row per range.
    parts = lasts.select("part")
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(by_part)).alias("next_part"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_Doc(d, t or "").row(_Doc(None, n or "")) for d, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(_schema(batch.schema.field(0).type))[:7]))

    pairs = lasts.join(turn, "part").join(firsts, "next_part").select("doc_id", "text", "next_text")
    straddling = pairs.mapInArrow(close, f"doc_id {id_type}, {_RESULT}")
    return done.filter("edge is null").drop("part", "edge", "text").union(straddling)


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_likeness(read_table(spark, sf_dir, "documents"))
