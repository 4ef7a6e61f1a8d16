"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are a hashed word embedding and the max-pooled embeddings of its hashed character n-grams. Both
tables start from smoothed log-odds of document counts over the labelled sample and are trained with the network.
Two gated recurrent layers read a window of words forwards and backwards, attention pools their states, and a logistic
unit scores the window. A document's score is that of its highest window, over overlapping windows that cover the
whole text, mapped to a probability by a logistic fit on labelled training documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.labelled import MAX_LABELLED, held_out, sigmoid, training_labels, with_labels
from siftlake.llm.pieces import blocks, task, texts_of
from siftlake.storage import Workspace, read_table, ship_package

WORD_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 15
GRAMS = (3, 4, 5)
WORD_DIM, GRAM_DIM, HIDDEN = 3, 3, 8
WINDOW, STRIDE = 64, 32
EPOCHS, BATCH, CHECKED = 6, 64, 8
CUT = 0.5

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_FACTOR = 0x9E3779B97F4A7C15


def _buckets(hashes: np.ndarray, size: int) -> np.ndarray:
    """Buckets 1 to size - 1 of 64-bit hashes. Bucket 0 is for padding."""
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((hashes >> np.uint64(32)) % np.uint64(size - 1)).astype(np.int32) + 1


class Inputs:
    """Input buckets of words: that of the word itself, and those of its character n-grams, with marks for its ends."""

    def __init__(self, words: list[str]):
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        chars = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        mixed = (chars + np.uint64(1)) * np.uint64(_FACTOR)
        mixed ^= mixed >> np.uint64(29)
        ends = np.cumsum(lengths)
        starts, word_of, at = ends - lengths, np.repeat(np.arange(len(words)), lengths), np.arange(len(chars))
        room = ends[word_of] - at
        powers = np.full(int(lengths.max(initial=1)), _FACTOR, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        whole = np.add.reduceat(mixed * powers[at - starts[word_of]], starts) if len(words) else np.zeros(0, np.uint64)
        self.words = _buckets(whole, WORD_BUCKETS)
        owners, grams = [], []
        for n in GRAMS:
            rolled = np.zeros(max(0, len(mixed) - n + 1), np.uint64)
            for k in range(n):
                rolled = rolled * np.uint64(_FACTOR) + mixed[k : k + len(rolled)]
            inside = np.flatnonzero(room[: len(rolled)] >= n)
            owners.append(word_of[inside])
            grams.append(_buckets(rolled[inside] + np.uint64(n), GRAM_BUCKETS))
        owner = np.concatenate(owners)
        self.grams = np.concatenate(grams)[np.argsort(owner, kind="stable")]
        self.sizes = np.bincount(owner, minlength=len(words))
        self.ends = np.cumsum(self.sizes)

    def take(self, rows: np.ndarray) -> Inputs:
        """The inputs of some of the words."""
        out = object.__new__(Inputs)
        out.words, out.sizes = self.words[rows], self.sizes[rows]
        out.ends = np.cumsum(out.sizes)
        out.grams = self.grams[np.repeat((self.ends - self.sizes)[rows] - (out.ends - out.sizes), out.sizes) + np.arange(out.sizes.sum())]
        return out


class Network:
    """Parameters p, forward pass, and gradients."""

    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.normal(0, 0.3, shape) / np.sqrt(shape[0])).astype(np.float32)
        words = rng.normal(0, 0.02, (WORD_BUCKETS, WORD_DIM)).astype(np.float32)
        grams = rng.normal(0, 0.02, (GRAM_BUCKETS, GRAM_DIM)).astype(np.float32)
        words[:, 0] += word_odds
        grams[:, 0] += gram_odds
        words[0] = 0
        grams[0] = -1
        d = WORD_DIM + GRAM_DIM
        self.p = {"words": words, "grams": grams, "pool": small(2 * HIDDEN), "out": small(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": small(d, 3 * HIDDEN), f"u{side}": small(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}

    def vectors(self, inputs: Inputs) -> tuple[np.ndarray, tuple]:
        """Input vectors of words (at least one), and what `winners` needs."""
        flat, sizes = inputs.grams, inputs.sizes
        starts = inputs.ends - sizes
        values = self.p["grams"][flat]
        top = np.maximum.reduceat(values, starts, axis=0)
        return np.hstack([self.p["words"][inputs.words], top]), (values, top, flat, sizes, starts)

    @staticmethod
    def winners(found) -> np.ndarray:
        """Of what `vectors` tells: the bucket of each word and gram dimension that gave the maximum."""
        values, top, flat, sizes, starts = found
        at = np.where(values == np.repeat(top, sizes, axis=0), np.arange(len(flat))[:, None], len(flat))
        return flat[np.minimum.reduceat(at, starts, axis=0)]

    def _layer(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """States of one direction: x is time, batch, 3 * HIDDEN (input projections)."""
        u, steps = self.p[f"u{side}"], len(x)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        states = np.empty((steps, x.shape[1], HIDDEN), np.float32)
        memory = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            zr = 0.5 * np.tanh(0.5 * (x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])) + 0.5
            z, r = zr[:, :HIDDEN] * mask[t], zr[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep:
                memory.append((t, h, zr[:, :HIDDEN], r, c, hu[:, 2 * HIDDEN :]))
            h = h + z * (c - h)
            states[t] = h
        return states, memory

    def logits(self, projected: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Window logits from projections (time, batch, 3 * HIDDEN) of both directions and a mask (time, batch, 1)."""
        sides = [self._layer(projected[s], mask, s, keep) for s in "fb"]
        states = np.concatenate([s[0] for s in sides], axis=2)
        energy = np.where(mask[:, :, 0] > 0, states @ self.p["pool"], np.float32(-1e9))
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return logit, (states, weight, pooled, [s[1] for s in sides])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight_of: np.ndarray):
        """Gradients of the weighted log loss, and that of the inputs x (time, batch, dimension)."""
        p, g = self.p, {}
        projected = {s: x @ p[f"w{s}"] + p[f"c{s}"] for s in "fb"}
        logit, (states, weight, pooled, memories) = self.logits(projected, mask, keep=True)
        d_logit = (sigmoid(logit) - y) * weight_of / len(y)
        g["out"], g["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()])
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["pool"] = np.einsum("tb,tbh->h", d_energy, states)
        d_states = weight[:, :, None] * d_pooled + d_energy[:, :, None] * p["pool"]
        d_x = np.zeros_like(x)
        for side, memory, part in zip("fb", memories, (slice(0, HIDDEN), slice(HIDDEN, None)), strict=True):
            u, w = p[f"u{side}"], p[f"w{side}"]
            d_u, d_w, d_c, d_h = np.zeros_like(u), np.zeros_like(w), np.zeros_like(p[f"c{side}"]), 0.0
            for t, h, z, r, c, hc in reversed(memory):
                d_new = d_states[t, :, part] + d_h
                zm = z * mask[t]
                d_z = d_new * (c - h) * mask[t] * z * (1 - z)
                d_cand = d_new * zm * (1 - c * c)
                d_r = d_cand * hc * r * (1 - r)
                d_proj = np.concatenate([d_z, d_r, d_cand], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_cand * r], axis=1)
                d_u += h.T @ d_hu
                d_w += x[t].T @ d_proj
                d_c += d_proj.sum(axis=0)
                d_x[t] += d_proj @ w.T
                d_h = d_new * (1 - zm) + d_hu @ u.T
            g[f"u{side}"], g[f"w{side}"], g[f"c{side}"] = d_u, d_w, d_c
        return g, d_x


def train(net: Network, docs: list[list[str]], labels: np.ndarray, seed: int = 3) -> None:
    """Adam over batches of windows of similar length; a word's own embedding is dropped at times, so that
    its characters have to carry the decision too.

    One window in CHECKED is kept apart: the network ends with the parameters of the epoch whose loss on these was least.
    """
    rng = np.random.default_rng(seed)
    usable = [i for i, d in enumerate(docs) if d]
    if not usable or labels.min() == labels.max():
        return
    apart = [i for n, i in enumerate(usable) if n % CHECKED == 0]
    usable = [i for n, i in enumerate(usable) if n % CHECKED] or usable
    usable.sort(key=lambda i: (len(docs[i]), i))
    place = {w: k for k, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    inputs = Inputs(list(place))
    rows_of = [np.fromiter(map(place.__getitem__, d), np.int64, len(d)) for d in docs]
    share = labels[usable].mean()
    weight_of = np.where(labels > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    first = {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("words", "grams")}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    step, best = 0, (np.inf, None)
    batches = [usable[i : i + BATCH] for i in range(0, len(usable), BATCH)]
    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            rows = batches[b]
            steps = max(len(docs[i]) for i in rows)
            distinct = np.unique(np.concatenate([rows_of[i] for i in rows]))
            own = inputs.take(distinct)
            found, told = net.vectors(own)
            table = np.vstack([np.zeros((1, found.shape[1]), np.float32), found])
            at = np.zeros((steps, len(rows)), dtype=np.int64)
            for j, i in enumerate(rows):
                at[: len(docs[i]), j] = np.searchsorted(distinct, rows_of[i]) + 1
            mask = (at > 0).astype(np.float32)[:, :, None]
            x = table[at]
            seen = (rng.random(at.shape) > 0.3)[:, :, None].astype(np.float32)
            x[:, :, :WORD_DIM] *= seen
            grads, d_x = net.gradients(x, mask, labels[rows].astype(np.float32), weight_of[rows].astype(np.float32))
            d_x[:, :, :WORD_DIM] *= seen
            d_table = np.zeros_like(table)
            np.add.at(d_table, at.ravel(), (d_x * mask).reshape(-1, d_x.shape[2]))
            step += 1
            scale = 0.01 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.p[k] -= (scale * first[k] / (np.sqrt(second[k]) + 1e-6)).astype(np.float32)
            # Embeddings take plain gradient steps, on the rows that were used.
            np.subtract.at(net.p["words"], own.words, 0.5 * d_table[1:, :WORD_DIM])
            top = net.winners(told)
            for k in range(GRAM_DIM):
                np.subtract.at(net.p["grams"][:, k], top[:, k], 0.5 * d_table[1:, WORD_DIM + k])
        logits = Scorer(net).logits([" ".join(docs[i]) for i in apart])
        q = np.clip(sigmoid(logits), 1e-6, 1 - 1e-6)
        loss = float(-(weight_of[apart] * np.where(labels[apart] > 0, np.log(q), np.log(1 - q))).mean())
        if loss < best[0]:
            best = loss, {k: v.copy() for k, v in net.p.items()}
    if best[1] is not None:
        net.p = best[1]


class Scorer:
    """Highest window logits of texts, with a cache of distinct words' projections."""

    def __init__(self, net: Network, most: int = 150_000):
        self.net, self.most = net, most
        self.at: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.at.clear()
        self.rows = np.zeros((4096, 6 * HIDDEN), np.float32)

    def _learn(self, new: list[str]) -> None:
        start = len(self.at) + 1
        while start + len(new) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            x = self.net.vectors(Inputs(part))[0]
            both = [x @ self.net.p[f"w{s}"] + self.net.p[f"c{s}"] for s in "fb"]
            self.rows[start + i : start + i + len(part)] = np.hstack(both)
        self.at.update(zip(new, range(start, start + len(new)), strict=True))

    def logits(self, texts: list[str]) -> np.ndarray:
        found = np.full(len(texts), -np.inf, dtype=np.float32)
        for a, b in blocks([len(t) for t in texts], 2_000_000):
            if len(self.at) > self.most:
                self._reset()
            cut = [words_of(t) for t in texts[a:b]]
            self._learn(list({w for ws in cut for w in ws}.difference(self.at)))
            windows, owner, short = [], [], []
            for i, words in enumerate(cut, a):
                ids = np.fromiter(map(self.at.__getitem__, words), np.int32, len(words))
                if len(ids) < WINDOW:
                    short.append((i, ids))
                    continue
                starts = [*range(0, len(ids) - WINDOW, STRIDE), len(ids) - WINDOW]
                windows += [ids[s : s + WINDOW] for s in starts]
                owner += [i] * len(starts)
            for s in range(0, len(windows), 2048):
                self._score(np.stack(windows[s : s + 2048], axis=1), np.array(owner[s : s + 2048]), found)
            short.sort(key=lambda x: len(x[1]))
            for s in range(0, len(short), 1024):
                part = short[s : s + 1024]
                at = np.zeros((max(1, len(part[-1][1])), len(part)), np.int32)
                for j, (_, ids) in enumerate(part):
                    at[: len(ids), j] = ids
                self._score(at, np.array([i for i, _ in part]), found)
        return found

    def _score(self, at: np.ndarray, owner: np.ndarray, found: np.ndarray) -> None:
        both = self.rows[at]
        mask = (at > 0).astype(np.float32)[:, :, None]
        logit, _ = self.net.logits({"f": both[:, :, : 3 * HIDDEN], "b": both[:, :, 3 * HIDDEN :]}, mask)
        np.maximum.at(found, owner, np.where(mask.any(axis=0)[:, 0], logit, -np.inf))


def _count_buckets(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of label 1 by word bucket and by gram bucket, from document counts over rows (text, label)."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + WORD_BUCKETS + GRAM_BUCKETS), np.int64)
        for batch in batches:
            texts, labels = texts_of(batch), batch.column(1).to_pylist()
            for a, b in blocks([len(t) for t in texts], 2_000_000):
                cut = [set(words_of(t)) for t in texts[a:b]]
                place = {w: k for k, w in enumerate(set().union(*cut))}
                inputs = Inputs(list(place))
                for words, label in zip(cut, labels[a:b], strict=True):
                    own = inputs.take(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
                    total[label, 0] += 1
                    total[label, 1 + np.unique(own.words)] += 1
                    total[label, 1 + WORD_BUCKETS + np.unique(own.grams)] += 1
        label, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.int32()), pa.array(slot, pa.int32()), pa.array(total[label, slot], pa.int64())], names=["label", "slot", "n"]
        )

    # The result has at most 2 * (1 + WORD_BUCKETS + GRAM_BUCKETS) rows.
    counted = rows.select("text", "label").mapInArrow(run, "label int, slot int, n long").groupBy("label", "slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((2, 1 + WORD_BUCKETS + GRAM_BUCKETS))
    total[counted.column("label").to_numpy(), counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    docs = total[:, :1] + 1.0
    odds = np.log((total[1] + 0.25) / docs[1]) - np.log((total[0] + 0.25) / docs[0])
    sure = (total[0] + total[1]) / (total[0] + total[1] + 2.0)
    odds = np.clip(odds * sure, -2.0, 6.0).astype(np.float32)
    return odds[1 : 1 + WORD_BUCKETS], odds[1 + WORD_BUCKETS :]


def highest_windows(rows: DataFrame, net: Network) -> tuple[list[list[str]], np.ndarray]:
    """Words of one window of every row (text, label), and the labels: a text's window whose words' starting log-odds
    have the largest sum of exponentials, the one that most likely decides its label. A shorter text is one window.

    Only these words come to the driver; rows are bounded by `labelled_texts`.
    """
    odds = rows.sparkSession.sparkContext.broadcast(np.exp(net.p["words"][:, 0]))

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = odds.value
        for batch in batches:
            texts, found = texts_of(batch), []
            for a, b in blocks([len(t) for t in texts], 2_000_000):
                cut = [words_of(t) for t in texts[a:b]]
                place = {w: k for k, w in enumerate({w for ws in cut for w in ws})}
                heavy = weight[Inputs(list(place)).words]
                for words in cut:
                    own = heavy[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].astype(np.float64)
                    sums = np.concatenate([[0.0], np.cumsum(own)]) if len(words) > WINDOW else np.zeros(WINDOW + 1)
                    start = int(np.argmax(sums[WINDOW:] - sums[:-WINDOW]))
                    found.append(" ".join(words[start : start + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(1)], names=["words", "label"])

    told = rows.select("text", "label").mapInArrow(run, "words string, label int").orderBy(F.xxhash64("words"), "words", "label").toArrow()
    seen: dict[str, str] = {}  # one object of each word
    windows = [[seen.setdefault(w, w) for w in t.as_py().split()] for t in told.column("words")]
    return windows, told.column("label").to_numpy().astype(np.float64)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    """text, label (0 or 1) of at most `most` labelled training ids. Of rows with one id, that whose text's hash is least counts."""
    chosen = with_labels(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), training_labels(labels, label, most))
    one = chosen.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("row"))
    return one.select("row.text", F.greatest(F.lit(0), F.least(F.lit(1), "label")).alias("label"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, work: Workspace, label: str = "toxic", most: int = MAX_LABELLED):
    """The network and the slope and offset that map a document's highest logit to a probability.

    At most `most` labelled training ids count. Their texts, of any length, set the embeddings' start, train the
    network with one window each, and set the final mapping. Without labelled rows of both classes the network keeps
    its start. Null and empty texts have no window.
    """
    chosen = work.table(labelled_texts(docs, labels, label, most), "labelled")
    net = Network(*_count_buckets(chosen))
    windows, y = highest_windows(chosen, net)
    if len(y):
        train(net, windows, y)
    shared = work.spark.sparkContext.broadcast(net)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            logits = scorer.logits(texts_of(batch)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(logits), batch.column(1)], names=["logit", "label"])

    told = chosen.select("text", "label").mapInArrow(run, "logit double, label int").orderBy("logit", "label").toArrow()
    work.drop("labelled")
    return net, _platt(told.column("logit").to_numpy(), told.column("label").to_numpy().astype(np.float64))


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0.1) and offset of a logistic fit by damped Newton steps."""
    seen = np.isfinite(logit)
    logit, y = logit[seen], y[seen]
    if not len(y):
        return 1.0, 0.0
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    # Targets short of 0 and 1 keep the slope finite where the labels are separated.
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(60):
        q = sigmoid(x @ w)
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (q - goal) + 1e-3 * (w - [1.0, 0.0])), -1.0, 1.0)
    return max(float(w[0]), 0.1), float(w[1])


def score_documents(docs: DataFrame, net: Network, mapping: tuple[float, float], column: str = "__sift_toxicity") -> DataFrame:
    """docs with a column (0 to 1) for its whole text. A text without words scores 0; a null text is an empty one.

    Rows are independent of each other, so nulls and repeated ids or rows pass through. Very long texts are scored
    whole, in blocks of windows. docs must not have the new column already (names that start with "__sift_" are
    reserved); other columns stay.
    """
    if column in docs.columns:
        raise ValueError(f"docs has a column {column} already")
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(net)  # of fixed size
    slope, offset = mapping

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            logits = scorer.logits(texts_of(batch)).astype(np.float64)
            scores = np.where(np.isfinite(logits), sigmoid(slope * np.where(np.isfinite(logits), logits, 0.0) + offset), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score is CUT or more. Columns stay; names that start with "__sift_" are reserved."""
    model = fit_toxicity(docs, labels, Workspace(docs.sparkSession, "toxicity"))
    return score_documents(docs, *model).filter(F.col("__sift_toxicity") < CUT).drop("__sift_toxicity")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, fitted on training rows of labels.toxic."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, Workspace(spark, "toxicity"))
    scored = score_documents(docs.select("doc_id", "text"), *model, column="score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
