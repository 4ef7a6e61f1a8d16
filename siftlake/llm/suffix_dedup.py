"""Repeated passages by a sparse suffix array.

Suffixes (of word sequences) are retained at minimisers only: in every run of MIN_WORDS words the (leftmost) position
whose KEY_WORDS words have the least hash. A run belongs to the suffix at its minimiser, and two copies of a run belong
to suffixes that agree around it. What decides about a suffix' runs is its context: at most MIN_WORDS words to the right
and MIN_WORDS - KEY_WORDS to the left.

The retained suffixes whose key another document has too are sorted by their words. Suffixes with equal contexts
collapse to that of the first document, which the others repeat whole. What is left of a key's suffixes are neighbours in
the sorted order: each is compared with up to NEAR after it, and the match is extended left and right word by
word. Where a key has more different contexts than that, the contexts' runs are grouped. A key of very many documents is
split over several tasks; what these leave open meets once more by runs. Matches merge to spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.pieces import task, texts_of, word_hashes
from siftlake.storage import Workspace, read_table

MIN_WORDS = 50
KEY_WORDS = 16
#: Words to the left of a suffix that its runs may hold.
REACH = MIN_WORDS - KEY_WORDS
#: A suffix is compared with so many neighbours at most; keys with more contexts are settled by runs.
NEAR = 15
#: Documents of one key in one task.
CELL_DOCS = 1024

_WORD = re.compile(r"\S+")
_FACTOR = 0x9E3779B97F4A7C15
_PLACE_BITS = 28


def _sliding(values: np.ndarray, span: int, fold) -> np.ndarray:
    """fold (minimum or maximum) over each run of span values."""
    width, folded = 1, values
    while 2 * width <= span:
        folded = fold(folded[:-width], folded[width:])
        width *= 2
    rest = span - width
    return fold(folded[:-rest], folded[rest:]) if rest else folded


class Suffixes:
    """The retained suffixes of one text: at (positions), keys, left and right (words of the context).

    Words are what white space separates; case counts. A text has 2^28 words at most.
    """

    def __init__(self, text: str):
        words = text.split()
        self.n = n = len(words)
        self.hashes = np.fromiter(map(word_hashes.__getitem__, words), np.uint64, n)
        if n < MIN_WORDS:
            self.at, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        rolled, width = self.hashes, 1
        while width < KEY_WORDS:  # KEY_WORDS is a power of two
            rolled = rolled[:-width] * np.uint64(pow(_FACTOR, width, 1 << 64)) + rolled[width:]
            width *= 2
        keys = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
        placed = (keys >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(keys), dtype=np.uint64)
        holder = (_sliding(placed, REACH + 1, np.minimum) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        firsts = np.flatnonzero(np.diff(holder, prepend=-1))  # the first run that belongs to each suffix
        lasts = np.append(firsts[1:], len(holder)) - 1
        self.at = holder[firsts]
        self.keys = keys[self.at].astype(np.int64)
        self.left, self.right = self.at - firsts, lasts + MIN_WORDS - self.at

    def contexts(self, rows: np.ndarray) -> Iterator[tuple[int, bytes, bytes, list[int]]]:
        """key, words to the right, words to the left (the nearest first), positions: the different contexts of some suffixes.

        A word is 4 bytes of its hash.
        """
        codes = (self.hashes >> np.uint64(32)).astype(">u4")
        forward, backward, n = codes.tobytes(), codes[::-1].tobytes(), self.n
        found: dict[tuple[int, bytes, bytes], list[int]] = {}
        for key, at, left, right in zip(*(x[rows].tolist() for x in (self.keys, self.at, self.left, self.right)), strict=True):
            found.setdefault((key, forward[4 * at : 4 * (at + right)], backward[4 * (n - at) : 4 * (n - at + left)]), []).append(at)
        for (key, right, left), places in found.items():
            yield key, right, left, places


def _row_key():
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))


def _key_rows(docs: DataFrame) -> DataFrame:
    """key, row_key: the retained suffixes' keys, each once a row."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(Suffixes(t).keys) for t in texts_of(batch)]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            keys = np.concatenate([np.zeros(0, np.int64), *found])
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(rows)], names=["key", "row_key"])

    return docs.select(_row_key().alias("row_key"), "text").mapInArrow(run, "key long, row_key long")


def _contexts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, cell, cells, right, left, doc_id, row_key, places: contexts of the suffixes whose key several documents have.

    A key's documents are dealt to `cells` cells, CELL_DOCS in each as far as their hashes spread. Rows that repeat
    both id and text are one document.
    """
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row_key").alias("low"), F.max("row_key").alias("high"))
    shared = counts.filter("low <> high").select("key", F.ceil(F.col("n") / CELL_DOCS).cast("int").alias("cells"))
    # A set: repeated rows have one row_key.
    lists = keys.join(shared.hint("merge"), "key").groupBy("row_key").agg(F.collect_set(F.struct("key", "cells")).alias("keys"))
    rows = docs.select(_row_key().alias("row_key"), "doc_id", "text").groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    rows = rows.join(lists.hint("merge"), "row_key")

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "cell", "cells", "right", "left", "doc_id", "row_key", "places"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            columns, owners, places, held = [[] for _ in types], [], [], 0

            def made(columns=columns, owners=owners, places=places, batch=batch):
                take = pa.array(owners, pa.int64())
                parts = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                return pa.RecordBatch.from_arrays([*parts, batch.column(1).take(take), batch.column(0).take(take), pa.array(places, pa.list_(pa.int32()))], names=names)

            for i, (text, row_key, wanted) in enumerate(zip(texts_of(batch), batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                suffixes, cells_of = Suffixes(text), {w["key"]: w["cells"] for w in wanted}
                rows = np.flatnonzero(np.isin(suffixes.keys, np.fromiter(cells_of, np.int64, len(cells_of))))
                for key, right, left, at in suffixes.contexts(rows):
                    cells = cells_of[key]
                    for column, value in zip(columns, (key, row_key % cells, cells, right, left), strict=True):
                        column.append(value)
                    owners.append(i)
                    places.append(at)
                held += len(rows)
                if held > 50_000:
                    yield made()
                    held = 0
                    for x in (*columns, owners, places):
                        x.clear()
            yield made()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key long, cell int, cells int, right binary, left binary, doc_id {id_type}, row_key long, places array<int>"
    return rows.select("row_key", "doc_id", "text", "keys").mapInArrow(run, schema)


class Neighbours:
    """Contexts of some whole cells in sorted order, as a matrix of words with the suffix at column REACH."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows, m = rows, len(rows)
        key, cell, self.cells = (rows.column(i).to_numpy() for i in range(3))
        self.words = np.zeros((m, REACH + MIN_WORDS), np.uint32)
        self.right, self.left = self._fill(rows.column(3), 1), self._fill(rows.column(4), -1)
        self.key = key
        new = np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))
        self.cell = np.cumsum(new) - 1
        equal = (self.right[1:] == self.right[:-1]) & (self.left[1:] == self.left[:-1]) & (self.words[1:] == self.words[:-1]).all(axis=1)
        self.first = np.maximum.accumulate(np.where(new | np.append(True, ~equal), np.arange(m), 0))  # of the rows with this context

    def _fill(self, column: pa.Array, step: int) -> np.ndarray:
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
        sizes, flat = np.diff(ends), np.frombuffer(column.buffers()[2] or b"", ">u4")[ends[0] : ends[-1]]
        row = np.repeat(np.arange(len(column)), sizes)
        at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
        self.words[row, REACH + at if step > 0 else REACH - 1 - at] = flat
        return sizes

    def copies(self) -> tuple[np.ndarray, ...]:
        """row, its left and right words, row of the first document: contexts that an earlier document has whole."""
        row = np.flatnonzero(self.first != np.arange(len(self.first)))
        return row, self.left[row], self.right[row], self.first[row]

    def order(self) -> np.ndarray:
        """Ranks of the rows' documents by doc_id (null first) and row_key."""
        table = pa.table({"d": self.rows.column(5), "r": self.rows.column(6)})
        index = pc.sort_indices(table, sort_keys=[("d", "ascending"), ("r", "ascending")], null_placement="at_start").to_numpy()
        rank = np.empty(len(index), np.int64)
        rank[index] = np.arange(len(index))
        return rank

    def extended(self, rows: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Like copies: of different contexts in one cell, the matches of at least MIN_WORDS words with neighbours."""
        row_key = self.rows.column(6).to_numpy()
        for step in range(1, NEAR + 1):
            a, b = rows[:-step], rows[step:]
            near = (self.cell[a] == self.cell[b]) & (row_key[a] != row_key[b])
            a, b = a[near], b[near]
            if not len(a):
                continue
            equal = self.words[a] == self.words[b]
            right = np.minimum(_leading(equal[:, REACH:]), np.minimum(self.right[a], self.right[b]))
            left = np.minimum(_leading(equal[:, REACH - 1 :: -1]), np.minimum(self.left[a], self.left[b]))
            long = left + right >= MIN_WORDS
            a, b, left, right = a[long], b[long], left[long], right[long]
            later = np.where(rank[a] < rank[b], b, a)
            yield later, left, right, np.where(later == a, b, a)

    def runs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows' contexts: row, words to the left of the suffix, hash of every run."""
        powers = np.array([pow(_FACTOR, MIN_WORDS - k, 1 << 64) for k in range(MIN_WORDS)], np.uint64)
        found = []
        for left in range(REACH + 1):
            own = rows[(self.left[rows] >= left) & (MIN_WORDS - left <= self.right[rows])]
            for at in range(0, len(own), 20_000):
                part = own[at : at + 20_000]
                hashes = (self.words[part, REACH - left : REACH - left + MIN_WORDS] * powers).sum(axis=1, dtype=np.uint64)
                found.append((part, np.full(len(part), left), hashes.astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def grouped(self, rows: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Like copies, for one run of a context at a time: runs that an earlier document of the cell has."""
        row, left, run = self.runs(rows)
        order = np.lexsort((rank[row], run, self.cell[row]))
        row, left, run = row[order], left[order], run[order]
        new = np.append(True, (run[1:] != run[:-1]) | (self.cell[row[1:]] != self.cell[row[:-1]]))[: len(row)]
        first = row[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]
        row_key = self.rows.column(6).to_numpy()
        later = row_key[row] != row_key[first]
        return row[later], left[later], MIN_WORDS - left[later], first[later]


def _leading(equal: np.ndarray) -> np.ndarray:
    """Number of true values before the first false one in each row."""
    return np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1))


def _matches(contexts: DataFrame) -> DataFrame:
    """doc_id, row_key, places, left, right, first_doc_id, key, run: matches around suffixes, and open runs.

    A match has a first_doc_id, an earlier document that holds the `left` words before and `right` words after the
    suffix too. Where key is set the row is an open run instead: its key is split over cells, and this is the first
    document with its context in its cell.
    """
    ordered = contexts.repartition("key", "cell").sortWithinPartitions("key", "cell", "right", "left", "doc_id", "row_key")
    names = ["doc_id", "row_key", "places", "left", "right", "first_doc_id", "key", "run"]

    def settle(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        array = Neighbours(rows)

        def told(row, left, right, first=None, key=None, run=None) -> pa.RecordBatch:
            take, none = pa.array(row, pa.int64()), pa.nulls(len(row), pa.int64())
            firsts = rows.column(5).take(pa.array(first, pa.int64())) if first is not None else pa.nulls(len(row), rows.column(5).type)
            parts = [rows.column(i).take(take) for i in (5, 6, 7)] + [pa.array(x, pa.int32()) for x in (left, right)]
            # A match may have an earlier document's null id; run and key tell matches from open runs.
            return pa.RecordBatch.from_arrays([*parts, firsts, none if key is None else pa.array(key), none if run is None else pa.array(run)], names=names)

        yield told(*array.copies())
        heads = np.flatnonzero(array.first == np.arange(len(array.first)))
        split = array.cells[heads] > 1
        per_cell = np.bincount(array.cell[heads], minlength=array.cell[-1] + 1)[array.cell[heads]]
        rank = array.order()
        for found in array.extended(heads[~split & (per_cell > 1) & (per_cell <= NEAR + 1)], rank):
            yield told(*found)
        many = heads[~split & (per_cell > NEAR + 1)]
        if len(many):
            yield told(*array.grouped(many, rank))
        if split.any():
            row, left, run = array.runs(heads[split])
            yield told(row, left, MIN_WORDS - left, key=array.key[row], run=run)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in filter(len, batches):
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key, cell = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            # The last cell may go on in the next batch.
            last = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield from settle(rows.slice(0, whole))
            held = rows.slice(whole)
        if held is not None:
            yield from settle(held)

    id_type = contexts.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_id {id_type}, row_key long, places array<int>, left int, right int, first_doc_id {id_type}, key long, run long")


def _closed_runs(matches: DataFrame) -> DataFrame:
    """Matches from the open runs: those that an earlier document in another cell has too."""
    runs = matches.filter("key is not null")
    held = F.struct("doc_id", "row_key")
    firsts = runs.groupBy("key", "run").agg(F.min(held).alias("first"), F.max(held).alias("last")).filter("first.row_key <> last.row_key")
    later = runs.drop("first_doc_id").join(firsts.select("key", "run", "first"), ["key", "run"]).filter("row_key <> first.row_key")
    return later.select("doc_id", "row_key", "places", "left", "right", F.col("first.doc_id").alias("first_doc_id"))


def _spans(matches: DataFrame) -> DataFrame:
    """doc_id, row_key, start_word, n_words, first_doc_id from matches around suffixes."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, sizes, firsts = [], [], [], []
            for i, found in enumerate(batch.column(2).to_pylist()):
                hits = [(at - f["left"], at + f["right"], f["first_doc_id"]) for f in found for at in f["places"]]
                hits.sort(key=lambda h: (h[0], h[2] is not None, h[2]))
                end = None
                for start, stop, first in hits:
                    if end is None or start > end:
                        rows.append(i)
                        starts.append(start)
                        firsts.append(first)
                        sizes.append(stop - start)
                        end = stop
                    elif stop > end:
                        sizes[-1] += stop - end
                        end = stop
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, batch.column(0).type)],
                names=["doc_id", "row_key", "start_word", "n_words", "first_doc_id"],
            )

    hits = F.collect_list(F.struct("places", "left", "right", "first_doc_id")).alias("hits")
    id_type = matches.schema["doc_id"].dataType.simpleString()
    grouped = matches.groupBy("doc_id", "row_key").agg(hits)
    return grouped.mapInArrow(run, f"doc_id {id_type}, row_key long, start_word long, n_words long, first_doc_id {id_type}")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, start_word, n_words, first_doc_id: the passages to remove.

    A word is in a span if a run of MIN_WORDS words around it stands in a document with a smaller doc_id too (null is
    smallest, ties by a hash of id and text); first_doc_id is such a document, for the span's first run. The first
    document of each passage has no span for it. Repetitions within one document do not count, nor do documents of
    fewer than MIN_WORDS words; rows that repeat both id and text are one document. row_key tells rows with equal ids
    apart. Texts of any length count whole; a null text is an empty one; an empty table gives no spans. Other columns
    are not read.
    """
    work = Workspace(docs.sparkSession, "suffixes")
    keys = work.table(_key_rows(docs), "keys")
    matches = work.table(_matches(_contexts(docs, keys)), "matches")
    work.drop("keys")
    found = matches.filter("key is null").drop("key", "run").unionByName(_closed_runs(matches))
    spans = work.table(_spans(found), "spans")
    work.drop("matches")
    return spans


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans (start, length; sorted, apart) and the white space after them."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, size in spans:
        out.append(text[at : words[start][0]])
        at = words[start + size][0] if start + size < len(words) else len(text)
    return "".join([*out, text[at:]])


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages (see `repeated_spans`) cut from text; n_chars follows where there is one.

    No row is dropped: a text that is nothing but repeated passages becomes empty. Other rows and columns stay; names
    that start with "__sift_" are reserved.
    """
    spans = repeated_spans(docs)
    per_row = spans.groupBy(F.col("row_key").alias("__sift_key")).agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias("__sift_cuts"))
    rows = docs.withColumn("__sift_row", _row_key())
    rows = rows.join(per_row, rows["__sift_row"] == per_row["__sift_key"], "left").drop("__sift_row", "__sift_key")
    text_at, cut_at = docs.columns.index("text"), len(docs.columns)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            for i, cuts in enumerate(batch.column(cut_at).to_pylist()):
                if cuts:
                    texts[i] = cut_spans(texts[i], [(c["start_word"], c["n_words"]) for c in cuts])
            columns = batch.columns[:cut_at]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:cut_at])

    cut = rows.mapInArrow(run, T.StructType(docs.schema.fields))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents that an earlier document has too: doc_id, start_word, n_words, first_doc_id."""
    return repeated_spans(read_table(spark, sf_dir, "documents")).select("doc_id", "start_word", "n_words", "first_doc_id")
