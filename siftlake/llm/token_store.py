"""Token-ID output as a content-addressed store.

Layout of a store folder, all Parquet:
  chunks/    chunk_id binary, n_ids int, ids binary   one row per distinct chunk; chunk_id is BLAKE2b-128 of its ids as
                                                      little-endian unsigned 32-bit integers; ids are zstd over
                                                      16-bit ones where all fit, else over the 32-bit ones
  recipes/   doc_id, n_ids long, chunk_ids array<binary>, root binary, part int, row long, local_start long
                                                      one row per document, part files and their rows in ascending
                                                      doc_id order; part numbers the files from 0, row a file's rows;
                                                      local_start counts the ids before it in its part; root is the
                                                      Merkle root of its chunk ids
  manifest/  level int, part int, run long, docs long, ids long, start long, root binary
                                                      level 0: RUN_ROWS neighbouring rows of a part, level 1: a part,
                                                      from the roots of its runs, and the ids before it; level 2: the
                                                      store, from the roots of its parts
Every document ends with END_ID, which is in no chunk: n_ids leaves it out, start, local_start and the manifest's ids
count it. A reader computes the manifest anew from the recipes, so a lost, changed or moved recipe is noticed.

A rolling (gear) hash over the last WINDOW ids cuts an id stream into chunks where its low bits are zero, so equal
passages give equal chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import public_tokenizers
from siftlake.llm.pieces import PIECE, blocks, spaced, task, texts_of
from siftlake.storage import Workspace, read_table, ship_package

TOKENIZER_FILE = "byte_bpe_50k.json"
END_ID = 0
WINDOW = 16
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 64, 9, 4096
#: Recipes under one root of the manifest's lowest level.
RUN_ROWS = 4096


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letters: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of large strings or large binaries that is no slice."""
    _, offsets, data = values.buffers()
    return np.frombuffer(offsets, np.int64, len(values) + 1), np.frombuffer(data or b"", np.uint8)


class LibraryEncoder:
    """Encodes texts with the tokenizers library, a block of them at a time.

    A block's words (see `pieces.spaced`) are numbered, each different one is encoded once, and the texts' ids are
    gathered by number, all outside Python. A run of letters, with the blank or line end before it, is one word to the
    tokenizer's pre-tokenizer too, and so is a run of marks after it (no mark starts anything longer before a mark), so
    marks are set apart first. What is left, a head, is kept with its ids from block to block; of more than `most` heads
    those of the last block stay. Heads of letters go to the tokenizer's model directly, others to its encode(), GROUP of
    them at a time. No alignments are made where nothing needs them. A text that holds an added token of the tokenizer
    goes to its encode() whole.
    """

    MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    #: Characters of a block's texts.
    BLOCK = 8_000_000
    GROUP = 32

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.split, self.tokenize = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        self.most = most
        self.spelling = np.arange(256, dtype="<u4")
        for byte, letter in _byte_letters().items():
            self.spelling[byte] = letter
        self.line_end = self._encode("\n")
        blank, vocab = chr(self.spelling[ord(" ")]), tokenizer.get_vocab()
        #: By id: whether the token can only be the first of a word, with a blank or line end before it.
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for token, i in vocab.items() if token.startswith(blank)]] = True
        self.starts[vocab[chr(self.spelling[ord("\n")])]] = True
        self.heads, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _encode(self, text: str) -> bytes:
        return array("I", [t.id for word, _ in self.split(text) for t in self.tokenize(word)]).tobytes()

    def _model(self, spelt: str) -> list[int]:
        return [t.id for t in self.tokenize(spelt)]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _grouped(self, heads: pa.Array, letters: bool) -> pa.Array:
        """The ids of heads, each after a blank if it has no line end. Where as many tokens start with a blank or are a line
        end as there are heads, no token reaches from one head into the next, so each was merged as it would be alone."""
        told = pc.if_else(pc.starts_with(heads, "\n"), heads, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), heads, pa.scalar("", pa.large_string())))
        offsets, data = _flat(told)
        if letters:  # as the model wants them, a character a byte
            text, bounds, run = self.spelling[data].tobytes().decode("utf-32-le"), offsets, self._model
        else:
            text, run = data.tobytes().decode(), self._whole
            bounds = np.concatenate([[0], np.cumsum(pc.utf8_length(told).to_numpy())])
        bounds, ids = bounds.tolist(), array("I")
        for i in range(0, len(heads), self.GROUP):
            ids.extend(run(text[bounds[i] : bounds[min(i + self.GROUP, len(heads))]]))
        at = np.flatnonzero(self.starts[np.frombuffer(ids, np.uint32)])
        if len(at) != len(heads):
            return pa.array([self._encode(t) for t in told.to_pylist()], pa.large_binary())
        at = np.append(at, len(ids)).astype(np.int64) * 4
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(at), pa.py_buffer(ids.tobytes())])

    def _new_ids(self, heads: pa.Array) -> pa.Array:
        """The ids of heads. One with a tab before it stands for what follows, without a blank."""
        odd = pc.starts_with(heads, "\t")
        letters = pc.utf8_is_alpha(pc.ascii_ltrim(heads, characters="\n"))
        kind = pc.if_else(odd, 2, pc.if_else(letters, 0, 1)).to_numpy()
        parts = [heads.filter(pa.array(kind == k)) for k in range(3)]
        lone = pa.array([self._encode(h[1:]) for h in parts[2].to_pylist()], pa.large_binary())
        found = pa.concat_arrays([self._grouped(parts[0], True), self._grouped(parts[1], False), lone])
        return found.take(pa.array(np.argsort(np.argsort(kind, kind="stable"))))

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """The ids of each of the different words of a block."""
        cut = pc.ascii_rtrim(words, characters=self.MARKS)
        letters = pc.utf8_is_alpha(pc.ascii_ltrim(cut, characters="\n"))
        heads = pc.if_else(letters, cut, words)
        (offsets, data), sizes = _flat(words), pc.binary_length(heads).to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - sizes)])  # of the marks after each head
        at = np.repeat(offsets[:-1] + sizes - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
        marks = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[at].tobytes())).dictionary_encode()
        told = pa.array([self._encode(m) if m else b"" for m in marks.dictionary.to_pylist()], pa.large_binary())

        numbered = pa.concat_arrays([self.heads, heads]).dictionary_encode()  # those known are different, so they come first
        numbers = numbered.indices.slice(len(self.heads))
        self.ids = pa.concat_arrays([self.ids, self._new_ids(pa.concat_arrays([numbered.dictionary.slice(len(self.heads))]))])
        self.heads = numbered.dictionary
        found = pc.binary_join_element_wise(self.ids.take(numbers), told.take(marks.indices), pa.scalar(b"", pa.large_binary()))
        if len(self.heads) > self.most:
            stay = pa.array(np.unique(numbers.to_numpy())[: self.most])
            self.heads, self.ids = self.heads.take(stay), self.ids.take(stay)
        return found

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        plain, plain_at, odd, odd_at, odd_sizes = [], [], [], [], []
        for i, text in enumerate(texts):
            if any(token in text for token in self.added):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            elif (line := spaced(text)) is not None:
                plain.append(line)
                plain_at.append(i)
            else:
                cut = [p[1:] if p[0] == " " and p[1:].strip() else "\t" + p for p in PIECE.findall(text)]
                odd += cut
                odd_at.append(i)
                odd_sizes.append(len(cut))
        lines = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        words = pa.concat_arrays([lines.flatten(), pa.array(odd, pa.large_string())]).dictionary_encode()
        ends, data = _flat(self._word_ids(words.dictionary).take(words.indices))
        ids, ends = data[: ends[-1]].view("<u4"), ends // 4
        sizes = np.concatenate([pc.list_value_length(lines).to_numpy(), np.array(odd_sizes, np.int64)])
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].tolist()
        skip = len(self.line_end) // 4
        for k, i in enumerate(plain_at):
            out[i] = ids[bounds[k] + skip : bounds[k + 1]]
        for k, i in enumerate(odd_at, len(plain_at)):
            out[i] = ids[bounds[k] : bounds[k + 1]]
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for a, b in blocks([len(t) for t in texts], self.BLOCK):
            yield from self._block(texts[a:b])


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One per process and file. Its heads stay from task to task, as far as it has room."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def _gear(ids: np.ndarray) -> np.ndarray:
    """Rolling hash of the WINDOW ids that end at each position: the sum of mixed ids, each shifted by its age."""
    mixed = ids.astype(np.uint32) + np.uint32(1)
    mixed *= np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    mixed ^= mixed >> np.uint32(13)
    span = 1
    while span < WINDOW:  # doubling: windows of 1, 2, 4, ... ids
        longer = mixed.copy()
        longer[span:] += mixed[:-span] * np.uint32(pow(0x2C9277B5, span, 1 << 32))
        mixed = longer
        span *= 2
    return mixed


def cut_candidates(streams: list[np.ndarray]) -> Iterator[list[int]]:
    """Where each stream may be cut, hashed in one go. Windows that begin in the stream before end before MIN_CHUNK ids,
    where nothing is cut."""
    ends = np.cumsum([len(ids) for ids in streams])
    found = np.flatnonzero(_gear(np.concatenate([np.zeros(0, "<u4"), *streams])) < np.uint32(1 << (32 - MASK_BITS))) + 1
    at = np.searchsorted(found, ends, side="right").tolist()
    for ids, end, a, b in zip(streams, ends.tolist(), [0, *at], at, strict=False):
        yield (found[a:b] - (end - len(ids))).tolist()


def cut_stream(ids: np.ndarray, candidates: list[int] | None = None) -> list[tuple[int, int]]:
    """Chunk ranges of one document's ids. MIN_CHUNK >= WINDOW, so a cut depends on ids of the chunk alone."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [(0, n)] if n else []
    if candidates is None:
        (candidates,) = cut_candidates([ids])
    cuts, start, i = [], 0, 0
    while n - start > MIN_CHUNK:
        while i < len(candidates) and candidates[i] < start + MIN_CHUNK:
            i += 1
        end = min(candidates[i] if i < len(candidates) else n, start + MAX_CHUNK, n)
        cuts.append((start, end))
        start = end
    if start < n:
        cuts.append((start, n))
    return cuts


def pack_ids(ids: np.ndarray, zstd: zstandard.ZstdCompressor) -> bytes:
    return zstd.compress((ids.astype("<u2") if ids.max() < 1 << 16 else ids.astype("<u4")).tobytes())


def unpack_ids(packed: bytes, n_ids: int, zstd: zstandard.ZstdDecompressor) -> np.ndarray:
    """The n_ids ids of a chunk; their number tells how wide they were stored."""
    raw = zstd.decompress(packed)
    if len(raw) not in (2 * n_ids, 4 * n_ids):
        raise ValueError("a chunk has not as many ids as its row says")
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n_ids else "<u4").astype("<u4")


def merkle_root(leaves: list[bytes]) -> bytes:
    """BLAKE2b-128 Merkle root; leaves and inner nodes are told apart by a prefix. No leaves: hash of nothing."""
    level = [hashlib.blake2b(b"\x00" + x, digest_size=16).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        pairs = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        level = [hashlib.blake2b(b"\x01" + p, digest_size=16).digest() for p in pairs]
    return level[0]


def _lists(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    """values cut into lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _stage(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """One row per document: its recipe, and those of its chunks that its task has not seen before."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(public_tokenizers.path(tokenizer_file))
        pack = zstandard.ZstdCompressor(level=3)
        seen: set[bytes] = set()
        for batch in batches:
            lengths, recipe, roots, sizes = [], [], [], []
            new_ids, new_sizes, new_packed, per_doc = [], [], [], []
            streams = list(encoder.encode(texts_of(batch)))
            for ids, candidates in zip(streams, cut_candidates(streams), strict=True):
                first, known = len(recipe), len(new_ids)
                narrow = ids.astype("<u2") if len(ids) and ids.max() < 1 << 16 else None
                for a, b in cut_stream(ids, candidates):
                    raw = ids[a:b]
                    chunk_id = hashlib.blake2b(raw, digest_size=16).digest()
                    recipe.append(chunk_id)
                    if chunk_id not in seen:
                        if len(seen) < 1_000_000:  # beyond it chunks may be sent twice; the store keeps one of them
                            seen.add(chunk_id)
                        new_ids.append(chunk_id)
                        new_sizes.append(b - a)
                        new_packed.append(pack_ids(raw, pack) if narrow is None else pack.compress(narrow[a:b]))
                lengths.append(len(ids))
                sizes.append(len(recipe) - first)
                per_doc.append(len(new_ids) - known)
                roots.append(merkle_root(recipe[first:]))
            new = [pa.array(new_ids, pa.binary()), pa.array(new_sizes, pa.int32()), pa.array(new_packed, pa.binary())]
            chunks = _lists(pa.StructArray.from_arrays(new, names=["chunk_id", "n_ids", "ids"]), per_doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), _lists(pa.array(recipe, pa.binary()), sizes), pa.array(roots, pa.binary()), chunks],
                names=["doc_id", "n_ids", "chunk_ids", "root", "new_chunks"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {id_type}, n_ids long, chunk_ids array<binary>, root binary, "
        "new_chunks array<struct<chunk_id: binary, n_ids: int, ids: binary>>",
    )


def _number_rows(recipes: DataFrame) -> DataFrame:
    """Recipes sorted by doc_id over the partitions, with their partition, their place and the ids before them in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, seen = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False) + 1
            ends = np.cumsum(sizes) + total
            total = int(ends[-1]) if len(ends) else total
            rows = np.arange(seen, seen + len(sizes))
            seen += len(sizes)
            extra = [pa.array(np.full(len(sizes), part), pa.int32()), pa.array(rows, pa.int64()), pa.array(ends - sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "row", "local_start"])

    ordered = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in recipes.schema)
    return ordered.mapInArrow(run, f"{fields}, part int, row long, local_start long")


def write_store(docs: DataFrame, work: Workspace, tokenizer_file: str = TOKENIZER_FILE) -> None:
    """Encode docs (doc_id, text) and write chunks, recipes and manifest into work's folder.

    Null and empty texts are documents of no chunks; a text of any length is encoded whole. Repeated doc_ids keep one
    recipe each, ordered among themselves by their Merkle root; a null doc_id sorts first. Other columns are not
    read. An empty table gives a store of no documents.
    """
    staged = work.table(_stage(docs, tokenizer_file), "staged")
    new = staged.select(F.explode("new_chunks").alias("c")).select("c.*")
    # Rows that share a chunk_id hold the same bytes; each task sends a chunk once, so groups are at most as large
    # as the number of tasks.
    work.table(new.groupBy("chunk_id").agg(F.first("n_ids").alias("n_ids"), F.first("ids").alias("ids")), "chunks")
    work.table(_number_rows(staged.select("doc_id", "n_ids", "chunk_ids", "root")), "recipes")
    work.drop("staged")
    work.table(_manifest(_recipes(work)), "manifest")


def _recipes(work: Workspace) -> DataFrame:
    return work.spark.read.parquet(work.path("recipes"))


def _fold(rows: DataFrame, keys: list[str], order: str, leaf: str) -> DataFrame:
    """keys, docs, ids, root: the Merkle root of each group's leaves by `order`. Groups are small: see `_manifest`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [[x["leaf"] for x in group] for group in batch.column(batch.num_columns - 1).to_pylist()]
            roots = pa.array([merkle_root(x) for x in leaves], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], roots], names=[*batch.schema.names[:-1], "root"])

    leaves = F.sort_array(F.collect_list(F.struct(order, F.expr(leaf).alias("leaf")))).alias("leaves")
    grouped = rows.groupBy(*keys).agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"), leaves)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema.fields[:-1])
    return grouped.mapInArrow(run, f"{fields}, root binary")


def _manifest(recipes: DataFrame) -> DataFrame:
    """The manifest of recipes. A run has RUN_ROWS rows at most, a part has as many runs as its rows by RUN_ROWS, and the
    store has as many parts as the sort had partitions; no group holds more leaves than that."""
    rows = recipes.select("part", F.expr(f"row div {RUN_ROWS}").alias("run"), "row", F.lit(1).alias("docs"), (F.col("n_ids") + 1).alias("ids"), "root", "local_start", "n_ids")
    told = "concat(root, cast(hex(row) as binary), cast('|' as binary), cast(hex(local_start) as binary), cast('|' as binary), cast(hex(n_ids) as binary))"
    runs = _fold(rows, ["part", "run"], "row", told)
    parts = _fold(runs, ["part"], "run", "root").withColumn("run", F.lit(None).cast("long"))
    store = _fold(parts.withColumn("all", F.lit(0)), ["all"], "part", "root").drop("all")
    store = store.withColumn("part", F.lit(None).cast("int")).withColumn("run", F.lit(None).cast("long"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per part
    nowhere = F.lit(None).cast("long")
    levels = [runs.withColumn("start", nowhere), parts.withColumn("start", before), store.withColumn("start", F.lit(0).cast("long"))]
    columns = ["part", "run", "docs", "ids", "start", "root"]
    named = [rows.select(F.lit(n).alias("level"), *columns) for n, rows in enumerate(levels)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def verify_manifest(work: Workspace) -> None:
    """Raise ValueError if the recipes are not those that the manifest was made from, at their places."""
    held = work.spark.read.parquet(work.path("manifest")).withColumn("side", F.lit(1))
    anew = _manifest(_recipes(work)).withColumn("side", F.lit(-1))
    odd = held.unionByName(anew).groupBy("level", "part", "run", "docs", "ids", "start", "root").agg(F.sum("side").alias("side"))
    wrong = odd.filter("side <> 0").orderBy("level", "part", "run").first()
    if wrong is not None:
        raise ValueError(f"the recipes do not match the manifest: level {wrong['level']}, part {wrong['part']}, run {wrong['run']}")


def read_chunks(work: Workspace) -> DataFrame:
    """chunk_id, n_ids, crc32: each stored chunk is unpacked and held against its id; a mismatch raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            crcs = []
            for chunk_id, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unpack_ids(packed, n, unpack).tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() != chunk_id:
                    raise ValueError(f"chunk {chunk_id.hex()} does not hold what its id says")
                crcs.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["chunk_id", "n_ids", "crc32"])

    stored = work.spark.read.parquet(work.path("chunks")).select("chunk_id", "n_ids", "ids")
    return stored.mapInArrow(run, "chunk_id binary, n_ids int, crc32 long")


def _recipe_items(work: Workspace) -> DataFrame:
    """Recipes by chunk, each document with its start. The manifest is verified before."""
    verify_manifest(work)
    offsets = work.spark.read.parquet(work.path("manifest")).filter("level = 1").select("part", F.col("start").alias("offset"))  # one row per part
    recipes = _recipes(work).join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("local_start"))
    return recipes.select("doc_id", "start", "n_ids", "root", F.posexplode_outer("chunk_ids").alias("ordinal", "chunk_id"))


def read_documents(work: Workspace) -> DataFrame:
    """doc_id, start, ids (array of int without the end id): documents put together again from recipes and chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                held = [unpack_ids(p["ids"], p["n_ids"], unpack) for p in parts if p["ids"] is not None]
                out.append(np.concatenate([np.zeros(0, "<u4"), *held]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    chunks = work.spark.read.parquet(work.path("chunks")).withColumnRenamed("n_ids", "c_ids")
    items = _recipe_items(work).join(chunks, "chunk_id", "left")
    # `start` is unique: every document holds at least its end id.
    docs = items.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.col("c_ids").alias("n_ids"), "ids"))).alias("parts"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, start long, ids array<int>")


_POLY = 0xEDB88320


def crc_shifts(n_bytes: np.ndarray) -> np.ndarray:
    """x to the powers 8 * n_bytes modulo the polynomial of crc32, bits reflected."""
    power, square, n = np.full(len(n_bytes), 1 << 31, np.uint32), np.array([1 << 23], np.uint32), n_bytes.astype(np.int64)
    while n.any():
        power = np.where(n & 1, _crc_products(power, np.broadcast_to(square, power.shape)), power)
        square = _crc_products(square, square)
        n = n >> 1
    return power


def crc_of_parts(lengths: np.ndarray, crcs: np.ndarray, sizes: np.ndarray, shifts: dict[int, int]) -> np.ndarray:
    """crc32 of concatenations from their parts' numbers of ids and crc32 values.

    sizes tells how many of the parts belong to each concatenation. All concatenations advance by one part at a
    time, those with parts left. shifts caches crc_shifts by number of ids.
    """
    new = [n for n in np.unique(lengths).tolist() if n not in shifts]
    shifts.update(zip(new, crc_shifts(4 * np.array(new, np.int64)).tolist(), strict=True))
    factors = np.array([shifts[n] for n in lengths.tolist()], dtype=np.uint32)
    crcs, starts = crcs.astype(np.uint32), np.cumsum(sizes) - sizes
    total = np.zeros(len(sizes), np.uint32)
    for turn in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > turn)
        at = starts[rows] + turn
        total[rows] = _crc_products(factors[at], total[rows]) ^ crcs[at]
    return total


def _crc_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of pairs of polynomials modulo that of crc32, bits reflected."""
    product = np.zeros_like(a)
    for bit in range(31, -1, -1):
        product ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return product


def read_digests(work: Workspace) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the store's files.

    Every chunk is read and verified once. A document's crc32 follows exactly from its chunks' crc32 values and
    lengths in recipe order, so the ids themselves are not shuffled again. Both counts hold the end id. The recipe's
    length and Merkle root are verified too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts: dict[int, int] = {}
        end = zlib.crc32(END_ID.to_bytes(4, "little"))
        for batch in filter(len, batches):
            counts, roots, parts = batch.column(2).to_numpy(), batch.column(3).to_pylist(), batch.column(4)
            items = parts.flatten()
            held = items.field("chunk_id").is_valid()
            ends = np.cumsum(pc.list_value_length(parts).to_numpy())
            ends = np.cumsum(np.concatenate([[0], held.to_numpy(zero_copy_only=False)]))[ends]  # without the row of a document of no chunks
            items = items.filter(held)
            chunk_ids, own = items.field("chunk_id").to_pylist(), items.field("n").fill_null(0).to_numpy()  # 0: not in the store
            starts = np.concatenate([[0], ends[:-1]])
            ids = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
            if (ids[ends] - ids[starts] != counts).any() or not own.all():
                raise ValueError("a recipe does not match its chunks")
            if [merkle_root(chunk_ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] != roots:
                raise ValueError("a recipe does not match its Merkle root")
            found = crc_of_parts(np.insert(own, ends, 1), np.insert(items.field("crc32").to_numpy(), ends, end), ends - starts + 1, shifts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts + 1, pa.int64()), pa.array(found)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    chunks = work.table(read_chunks(work), "read_back").withColumnRenamed("n_ids", "n")
    items = _recipe_items(work).join(chunks, "chunk_id", "left")
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "chunk_id", "n", "crc32"))).alias("parts")
    docs = items.groupBy("doc_id", "start", "n_ids", "root").agg(parts)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer_file: str = TOKENIZER_FILE) -> Workspace:
    """Write a store of docs in the shared storage and return its workspace, to read from."""
    ship_package(docs.sparkSession)
    work = Workspace(docs.sparkSession, "token-store")
    write_store(docs, work, tokenizer_file)
    return work


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as read back from a store of all documents."""
    return read_digests(token_store(read_table(spark, sf_dir, "documents")))
