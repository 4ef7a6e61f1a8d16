"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

Shingles are five neighbouring words of the lower-cased text. A shingle weighs its count in the document times a
damped inverse document frequency. Improved consistent weighted sampling draws a signature whose samples
agree with the probability of the weighted Jaccard similarity; bands of the signature give buckets; within a bucket
documents are compared with a representative, and those that this leaves in different components meet again where an
exact prefix filter allows their similarity. Every link is verified by the exact weighted Jaccard similarity.

Document frequencies are counted over all documents in a hashed table of fixed size. What other shingles add to a slot
is estimated by the table's median and taken off. Texts that are equal are one node; copies never meet pairwise.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.components import component_stars, connected_components
from siftlake.llm.pieces import blocks, task, texts_of
from siftlake.llm.pieces import word_hashes as hash_of
from siftlake.storage import Workspace, read_table

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 16 bands of 5 samples find a pair of similarity 0.8 with probability 0.998, one of 0.9 with 0.999999.
BANDS, BAND_ROWS = 16, 5
DF_BITS, DF_BLOCKS = 22, 256
#: Pairs that agree in fewer samples are not verified. Of similarity 0.8 or more, one in ten million pairs does so.
LEAST_MATCHES = 44
#: Relative slack of the bounds in `prefixes` and `open_pairs`, for sums in another order.
_SLACK = 1e-6
#: Share of the inverse document frequency in a weight. It is small, so that the size of a group of near copies, which
#: is also the frequency of what they share, does not push its own members apart.
IDF_SHARE = 0.2

_SAMPLES = BANDS * BAND_ROWS
_SEED_BITS = 16
_LEVEL_STEP = 0.05


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words between white space."""
    words = text.lower().split()
    return np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))


def shingles(text: str, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their counts. A shorter text is one shingle; a text without words has none."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = min(width, n)
    rolled = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i]
    return np.unique(_mix(rolled + np.uint64(width)), return_counts=True)


class Weights:
    """TF-IDF weights from hashed document frequencies."""

    def __init__(self, slots: np.ndarray, documents: int):
        self.slots, self.load = slots, float(np.median(slots))
        self.top = np.log(documents + 2.0)
        self.scale = 1.0 / self.top

    def idf(self, hashes: np.ndarray) -> np.ndarray:
        """1 + IDF_SHARE * ln((N + 2) / (df + 1)) / ln(N + 2), which lies in [1, 1 + IDF_SHARE]."""
        df = np.maximum(self.most(hashes) - self.load, 1.0)
        return 1.0 + IDF_SHARE * np.maximum(0.0, self.top - np.log(df + 1.0)) * self.scale

    def most(self, hashes: np.ndarray) -> np.ndarray:
        """No shingle is in more documents than that."""
        return self.slots[(hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)]

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = shingles(text)
        return hashes, counts * self.idf(hashes)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima by sum of maxima of two weighted sets (sorted hashes, weights). Two empty sets: 0."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - common
    return float(common / union) if union else 0.0


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010): for element h and sample k draw r, c ~ Gamma(2, 1) and
    b ~ U(0, 1); t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)); the element of least a and its t
    are the sample. The draws come from a table of 2^16 triples that a hash of (h, k) picks; ln w is rounded to steps of
    0.05, so ln a and t are look-ups by step and triple."""

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        size = 1 << _SEED_BITS
        self.r = rng.gamma(2.0, 1.0, size)
        self.log_c = np.log(rng.gamma(2.0, 1.0, size))
        self.beta = rng.random(size)
        self.factors = (rng.integers(0, 1 << 63, _SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.row_of = np.full(1024, -1)
        self.log_a = np.zeros((8, size), np.float32)
        self.t = np.zeros((8, size), np.int32)
        self.n_rows = 0

    def _rows(self, levels: np.ndarray) -> np.ndarray:
        """Rows of the look-up tables for steps; those that come up first are added."""
        for level in np.unique(levels).tolist():
            if self.row_of[level] >= 0:
                continue
            if self.n_rows == len(self.t):
                self.log_a, self.t = (np.vstack([x, np.zeros_like(x)]) for x in (self.log_a, self.t))
            t = np.floor(level * _LEVEL_STEP / self.r + self.beta)
            self.log_a[self.n_rows] = self.log_c - self.r * (t - self.beta) - self.r
            self.t[self.n_rows] = t
            self.row_of[level] = self.n_rows
            self.n_rows += 1
        return self.row_of[levels]

    def bands(self, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, bytes]:
        """BANDS hashes of BAND_ROWS samples each, and 16 bits of every sample; none for an empty set."""
        if not len(hashes):
            return np.zeros(0, np.int64), b""
        levels = self._rows(np.minimum(np.rint(np.log(weights) / _LEVEL_STEP).astype(np.int64), len(self.row_of) - 1))
        flat_a, flat_t = self.log_a.ravel(), self.t.ravel()
        best = np.full(_SAMPLES, np.inf, np.float32)
        chosen = np.zeros(_SAMPLES, np.uint64)
        for s in range(0, len(hashes), 4096):
            h = hashes[s : s + 4096]
            at = ((self.factors[:, None] * h[None, :]) >> np.uint64(64 - _SEED_BITS)).astype(np.int64)
            at += (levels[s : s + 4096] << _SEED_BITS)[None, :]
            a = flat_a[at]
            low = a.argmin(axis=1)
            rows = np.arange(_SAMPLES)
            better = a[rows, low] < best
            best = np.where(better, a[rows, low], best)
            sample = _mix(h[low] + flat_t[at[rows, low]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            chosen = np.where(better, sample, chosen)
        grouped = chosen.reshape(BANDS, BAND_ROWS)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(BAND_ROWS):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, i])
        return out.astype(np.int64), (chosen >> np.uint64(48)).astype("<u2").tobytes()


def text_key():
    """128 bits of a text as a struct; null and empty texts are the same. Of the type that it has in written tables, or a
    join with one would move rows that lie right already."""
    text = F.coalesce("text", F.lit(""))
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(0x51F7), text).alias("k2")).cast("struct<k1: bigint, k2: bigint>")


def count_documents(docs: DataFrame, work: Workspace) -> Weights:
    """Document frequencies of all shingles of all documents: each task counts into a table of 2^DF_BITS slots; the
    tables are summed by blocks of slots, and only the sum, of fixed size, comes to the driver."""
    width = (1 << DF_BITS) // DF_BLOCKS

    @task
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n, pack = np.zeros(1 << DF_BITS, np.int64), 0, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for text in texts_of(batch):
                hashes, _ = shingles(text)
                np.add.at(table, (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64), 1)
                n += 1
        if n:
            blobs = [pack.compress(part.tobytes()) for part in table.reshape(DF_BLOCKS, width)]
            counts = [n, *[0] * (DF_BLOCKS - 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(DF_BLOCKS), pa.int32()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["block", "docs", "slots"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        docs_of: dict[int, int] = {}
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, n, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(unpack.decompress(slots), np.int64)
                sums[block] = sums[block] + part if block in sums else part
                docs_of[block] = docs_of.get(block, 0) + n
        blobs = [pack.compress(sums[b].tobytes()) for b in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([docs_of[b] for b in sums], pa.int64()), pa.array(blobs, pa.binary())], names=["block", "docs", "slots"]
        )

    schema = "block int, docs long, slots binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    table, n = np.zeros((DF_BLOCKS, width), np.int64), 0
    for row in work.table(parts, "frequencies").collect():
        table[row["block"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["slots"])), np.int64)
        n += row["docs"]
    work.drop("frequencies")
    return Weights(table.ravel().astype(np.float32), n)


def candidate_bands(docs: DataFrame, work: Workspace, weights) -> DataFrame:
    """key, bands, samples of every distinct text that has words."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, tfidf = Sampler(), weights.value
        for batch in batches:
            found = [sampler.bands(*tfidf.of(t)) for t in texts_of(batch)]
            columns = [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "bands", "samples"])

    signed = docs.select(text_key().alias("key"), "text").mapInArrow(run, "key struct<k1: bigint, k2: bigint>, bands array<bigint>, samples binary")
    return signed.filter("size(bands) > 0").groupBy("key").agg(F.first("bands").alias("bands"), F.first("samples").alias("samples"))


def plausible(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that agree in LEAST_MATCHES samples (m, samples). It keeps texts of unlike pairs from being moved."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.array([np.frombuffer(x, "<u2") for x in batch.column(i).to_pylist()]).reshape(len(batch), -1) for i in (2, 3))
            likely = pa.array((left == right).sum(axis=1) >= LEAST_MATCHES)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(likely), batch.column(1).filter(likely)], names=["a", "b"])

    both = pairs.hint("merge").join(samples.select(F.col("m").alias("a"), F.col("samples").alias("a_samples")), "a")
    both = both.hint("merge").join(samples.select(F.col("m").alias("b"), F.col("samples").alias("b_samples")), "b")
    key = "struct<k1: bigint, k2: bigint>"
    return both.select("a", "b", "a_samples", "b_samples").mapInArrow(run, f"a {key}, b {key}")


def verify(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """Those of pairs (a, b) whose texts have a weighted Jaccard similarity of at least SIMILARITY."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tfidf, recent = weights.value, OrderedDict()
        for batch in batches:
            links = []
            for key, text, other in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                key = (key["k1"], key["k2"])
                if key not in recent:
                    recent[key] = tfidf.of(other)
                    if len(recent) > 64:
                        recent.popitem(last=False)
                links.append(weighted_jaccard(tfidf.of(text), recent[key]) >= SIMILARITY)
            mask = pa.array(links, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    # Sort-merge joins at every size: neither side is bounded.
    both = pairs.hint("merge").join(texts.select(F.col("key").alias("a"), F.col("text").alias("a_text")), "a")
    both = both.hint("merge").join(texts.select(F.col("key").alias("b"), F.col("text").alias("b_text")), "b")
    key = "struct<k1: bigint, k2: bigint>"
    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, f"a {key}, b {key}")


def prefixes(members: DataFrame, weights) -> DataFrame:
    """m, root, token, total, rest: for members (m, root, text), the shingles that two similar texts can share first.

    All texts order their shingles alike, rare ones first. rest is the weight from a shingle to the end, total that of
    all. Of texts of similarity s, total weights A and B and common weight C, C is at least s * max(A, B), and the
    first common shingle has at least C after it in both: one with a rest below SIMILARITY * total is never that. A
    shingle of one document is in no other.
    """

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tfidf = weights.value
        for batch in batches:
            texts = texts_of(batch)
            for start, end in blocks([len(t) for t in texts]):
                rows, tokens, totals, rests = [], [], [], []
                for i in range(start, end):
                    hashes, w = tfidf.of(texts[i])
                    df = tfidf.most(hashes)
                    order = np.lexsort((hashes, df))
                    rest = np.cumsum(w[order][::-1])[::-1]
                    kept = (rest >= SIMILARITY * (1 - _SLACK) * rest[0]) & (df[order] > 1)
                    rows.append(np.full(kept.sum(), i))
                    tokens.append(hashes[order][kept].astype(np.int64))
                    totals.append(np.full(kept.sum(), rest[0]))
                    rests.append(rest[kept])
                at = pa.array(np.concatenate(rows))
                columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.concatenate(x)) for x in (tokens, totals, rests))]
                yield pa.RecordBatch.from_arrays(columns, names=["m", "root", "token", "total", "rest"])

    key = "struct<k1: bigint, k2: bigint>"
    return members.select("m", "root", "text").mapInArrow(run, f"m {key}, root {key}, token long, total double, rest double")


def open_prefixes(members: DataFrame, stars: DataFrame, texts: DataFrame, weights, work: Workspace) -> DataFrame:
    """`prefixes` of members (m, bucket, head) that can have links to other components.

    Every member was compared with its bucket's head; stars are the components of these links. A node's root is the least
    node of its component, itself without links. Members of buckets whose other members have several roots are asked.
    """
    others = members.filter("m <> head").select("m", "bucket")
    rooted = others.join(stars.select(F.col("a").alias("m"), F.col("b").alias("root")), "m", "left").withColumn("root", F.coalesce("root", "m"))
    rooted = work.table(rooted, "bucket-roots")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    asked = work.table(rooted.join(mixed, "bucket", "left_semi").select("m", "root").distinct(), "asked")
    found = work.table(prefixes(asked.hint("merge").join(texts.withColumnRenamed("key", "m"), "m"), weights), "prefixes")
    work.drop("bucket-roots", "asked")
    return found


def foremost(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of found (see `prefixes`), for each token and root the row with the largest share of its weight from the token on, and
    of these the first one of each token. Among near copies that is a text with few shingles of its own, to which the
    others are nearest."""
    best = F.max(F.struct((F.col("rest") / F.col("total")).alias("share"), "m", "root", "total", "rest")).alias("best")
    firsts = found.groupBy("token", "root").agg(best).select("token", "best.*")
    return firsts, firsts.groupBy("token").agg(best).select("token", "best.*")


def open_pairs(found: DataFrame, centres: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of found (see `prefixes`), or of found and centres, that can join two components: their roots differ, they
    share a shingle of both prefixes, and their weights from that shingle on leave a similarity of SIMILARITY possible."""
    columns = ("m", "root", "total", "rest")
    left, right = (df.select("token", *(F.col(c).alias(f"{side}_{c}") for c in columns)) for df, side in ((found, "a"), (centres or found, "b")))
    apart = F.col("a_root") < F.col("b_root") if centres is None else F.col("a_root") != F.col("b_root")
    enough = F.least("a_rest", "b_rest") * (1 + SIMILARITY) >= SIMILARITY * (1 - _SLACK) * (F.col("a_total") + F.col("b_total"))
    meet = left.join(right, (left["token"] == right["token"]) & apart & enough)
    return meet.select(F.greatest("a_m", "b_m").alias("a"), F.least("a_m", "b_m").alias("b")).distinct()


def similar_texts(docs: DataFrame, work: Workspace) -> DataFrame:
    """a, b: links between distinct texts, enough of them to give the components of all links in buckets.

    A bucket's members are compared with its head, the member whose buckets are largest together: of a group of copies
    that is one with few changes, to which the others are nearest. Other pairs are compared only where they can join
    two components of the links that are known (see `open_pairs`): at first the foremost members of components
    with one of them, and once these have joined what they can, every pair that is left. No pair of a bucket with that similarity and different
    components is missing. Signatures are compared first, texts where these agree enough.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(count_documents(docs, work))  # 2^DF_BITS numbers
    signed = work.table(candidate_bands(docs, work, weights), "signed")
    dealt = signed.select(F.col("key").alias("m"), F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = work.table(dealt.join(shared.hint("merge"), "bucket"), "shared")
    # Sort-merge joins at every size: no side is bounded.
    central = dealt.groupBy("m").agg(F.sum("n").alias("centrality"))
    dealt = work.table(dealt.join(central.hint("merge"), "m"), "central")
    heads = dealt.groupBy("bucket").agg(F.max(F.struct("centrality", "m")).alias("top")).select("bucket", F.col("top.m").alias("head"))
    members = work.table(dealt.select("m", "bucket", "n").join(heads.hint("merge"), "bucket"), "members")
    samples = signed.select(F.col("key").alias("m"), "samples").join(central.select("m").hint("merge"), "m", "left_semi")
    samples = work.table(samples, "samples")
    work.drop("signed", "shared", "central")

    tried = members.filter("m <> head").select(F.greatest("m", "head").alias("a"), F.least("m", "head").alias("b")).distinct()
    tried = work.table(plausible(tried, samples), "pairs")
    # Texts of pairs, and of buckets with members that were not compared with each other.
    wanted = tried.select(F.col("a").alias("key")).union(tried.select("b")).union(members.filter("n > 2").select("m")).distinct()
    # Copies go before the shuffle, where a task has several.
    keyed = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    texts = work.table(keyed.join(wanted.hint("merge"), "key", "left_semi"), "texts")

    # Roots have to be those of whole components: a group of near copies that is told apart anywhere meets itself in all pairs.
    stars = component_stars(work.table(verify(tried, texts, weights), "found"), work, "stars")
    found = open_prefixes(members, stars, texts, weights, work)
    pairs = work.table(plausible(open_pairs(*foremost(found)).hint("merge").join(tried, ["a", "b"], "left_anti"), samples), "pairs-foremost")
    stars = component_stars(stars.union(verify(pairs, texts, weights)), work, "joined")
    roots = stars.select(F.col("a").alias("m"), F.col("b").alias("joined"))
    found = found.hint("merge").join(roots, "m", "left").withColumn("root", F.coalesce("joined", "root"))
    pairs = work.table(plausible(open_pairs(found).hint("merge").join(tried, ["a", "b"], "left_anti"), samples), "pairs-open")
    work.drop("members", "prefixes", "pairs", "pairs-foremost", "samples")
    return stars.union(work.table(verify(pairs, texts, weights), "found-open"))


def classes(docs: DataFrame) -> DataFrame:
    """key, least (a struct of the least doc_id and its text's key) of every distinct text: its class' first document."""
    work = Workspace(docs.sparkSession, "near-dedup")
    links = similar_texts(docs, work)
    work.drop("texts", "found", "pairs-open")
    roots = connected_components(links, work)
    firsts = docs.select("doc_id", text_key().alias("key")).groupBy("key").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    rooted = firsts.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = work.table(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    known = work.table(rooted.join(least, "root").select("key", "least"), "classes")
    work.drop(*(n for n in work.names() if n != "classes"))
    return known


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept of every row.

    class_id is the least doc_id of the row's class: equal texts (null is the empty text), and texts connected by
    links of weighted Jaccard similarity of at least SIMILARITY. kept marks one text of each class; rows that repeat
    both its doc_id and its text are all marked. A null doc_id counts as least. A text without words is like no
    other text but its copies. Texts of any length count whole. An empty table gives an empty one; other columns are not read.
    """
    known = classes(docs)
    rows = docs.select("doc_id", text_key().alias("key")).join(known, "key")
    kept = F.struct("doc_id", "key").eqNullSafe(F.col("least"))
    return rows.select("doc_id", F.col("least.doc_id").alias("class_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near duplicates (see `near_duplicates`).

    Of rows that repeat both doc_id and text the one with the least hash of all columns stays. Columns stay as they
    are; names that start with "__sift_" are reserved.
    """
    # Joined by id and text: the copies of one text lie in as many groups as they have ids.
    right = classes(docs).filter("key = least.key").select(F.col("least").alias("__sift_kept"))
    rows = docs.withColumn("__sift_row_key", F.struct("doc_id", text_key().alias("key")))
    rows = rows.join(right.hint("merge"), rows["__sift_row_key"] == right["__sift_kept"], "left_semi")
    whole = F.struct(*docs.columns)
    return rows.groupBy("__sift_row_key").agg(F.min_by(whole, F.xxhash64(whole)).alias("__sift_row")).select("__sift_row.*")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
