"""A quality classifier on random-indexing word vectors.

Every token type has a sparse ternary index vector, drawn from its hash. A
token's word vector is the sum of the index vectors that stand near it, over
the whole corpus. A document is the pooled vectors of its tokens. A two-layer
network in NumPy maps that to a probability, whose temperature is fitted on
labelled rows that the network has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import id_text, small_batches, text_or_empty, written
from geoloom.llm.kernels import LOWER, blocks, mix

#: Token types are hashed to so many; vectors have so many dimensions, of which the index vectors use a few.
TYPES, DIMENSIONS, NONZERO, WINDOW = 16_384, 32, 4, 2
#: The network is fitted on at most so many labelled rows, those with the least hashes of their ids.
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 150, 0.01, 1e-4
#: Every so many-th of the labelled rows fits the temperature alone.
CALIBRATION = 5
#: Token types of a table part; parts are what tasks send to be summed.
PART = 512
#: Tasks whose sums are added up first, as many for each part.
SUMMERS = 64

_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in (9, 11, 12, 13, 32) for b in range(256)])
#: Classes of bytes: a token is a run of one class. White space but for line ends is no token.
_CLASS = np.select([_SPACE, _DIGIT, _LETTER, np.arange(256) == 10], [0, 1, 2, 3], 4).astype(np.int8)
_ALL_UPPER, _NUMBER = 1, 2


def token_types(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The token types of each text end to end, and how many each text has.

    Words are lowered; words in capitals and numbers are one type each; runs of
    other signs and line ends are types by their bytes.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = _CLASS[raw]
    change = np.flatnonzero(np.diff(kind)) + 1
    start = np.concatenate([[0], change])
    stop = np.concatenate([change, [len(raw)]])
    solid = kind[start] > 0
    start, stop = start[solid], stop[solid]
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    if not len(start):
        return np.zeros(0, np.int64), counts
    # The hash of a run is the sum of its bytes' hashes, each times a factor for its place.
    size = stop - start
    firsts = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(firsts, size)
    at = np.repeat(start, size) + place
    powers = mix(np.arange(1, int(size.max()) + 1, dtype=np.uint64))
    hashes = np.add.reduceat(mix(LOWER[raw[at]].astype(np.uint64) + np.uint64(1)) * powers[place], firsts)
    upper = np.add.reduceat(_UPPER[raw[at]].astype(np.int64), firsts)
    types = (mix(hashes) % np.uint64(TYPES)).astype(np.int64)
    types[(upper == size) & (size > 1)] = _ALL_UPPER
    types[kind[start] == 1] = _NUMBER
    return types, counts


def index_vectors() -> np.ndarray:
    """The sparse ternary index vector of each token type."""
    at = np.arange(TYPES * NONZERO, dtype=np.uint64).reshape(TYPES, NONZERO)
    draw = mix(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    out = np.zeros((TYPES, DIMENSIONS), np.float32)
    np.add.at(out, (np.arange(TYPES)[:, None], (draw % np.uint64(DIMENSIONS)).astype(np.int64)), np.where(draw >> np.uint64(63), 1.0, -1.0))
    return out


def _context_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's sums of index vectors near each token type, and how often the type stood there."""
    index = index_vectors()
    sums = np.zeros((TYPES, DIMENSIONS + 1), np.float64)
    for pdf in batches:
        for _, block in blocks(pdf["text"].tolist(), 1_000_000):
            types, counts = token_types(block)
            if not len(types):
                continue
            owner = np.repeat(np.arange(len(counts)), counts)
            near = np.zeros((len(types), DIMENSIONS), np.float32)
            vectors = index[types]
            for d in range(1, WINDOW + 1):
                both = (owner[d:] == owner[:-d])[:, None]
                near[d:] += np.where(both, vectors[:-d], 0)
                near[:-d] += np.where(both, vectors[d:], 0)
            order = np.argsort(types, kind="stable")
            some, first = np.unique(types[order], return_index=True)
            sums[some, :DIMENSIONS] += np.add.reduceat(near[order], first)
            sums[:, DIMENSIONS] += np.bincount(types, minlength=TYPES)
    parts = sums.reshape(TYPES // PART, -1)
    full = np.flatnonzero(np.abs(parts).any(axis=1))
    if len(full):
        yield pd.DataFrame({"part": full.astype(np.int32), "task": TaskContext.get().partitionId() % SUMMERS, "sums": [parts[i].tobytes() for i in full]})


def _added(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(PART * (DIMENSIONS + 1))
    for pdf in batches:
        for x in pdf["sums"]:
            total += np.frombuffer(x)
    yield pd.DataFrame({"part": [key[0]], "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors of all token types from the whole of docs(text).

    Tasks sum over their rows, and the partial sums are added up by table part.
    What reaches the driver is one table of TYPES rows, whatever the corpus.
    """
    sums = docs.select(text_or_empty().alias("text")).mapInPandas(_context_sums, "part int, task int, sums binary")
    # Sums of whole numbers, so their order does not matter. Two levels: first over some of the tasks, then over all.
    some = sums.groupBy("part", "task").applyInPandas(_added, "part int, sums binary")
    rows = some.groupBy("part").applyInPandas(_added, "part int, sums binary").collect()
    table = np.zeros((TYPES // PART, PART * (DIMENSIONS + 1)))
    for r in rows:
        table[r["part"]] = np.frombuffer(r["sums"])
    table = table.reshape(TYPES, DIMENSIONS + 1)
    seen = table[:, DIMENSIONS]
    common = table[:, :DIMENSIONS].sum(axis=0) / max(1.0, seen.sum())
    vectors = table[:, :DIMENSIONS] / np.maximum(seen, 1)[:, None] - common
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    vectors[seen == 0] = 0
    return vectors.astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """For each text the mean and the spread of its tokens' vectors; zeros without tokens."""
    out = []
    for _, block in blocks(texts, 1_000_000):
        types, counts = token_types(block)
        made = np.zeros((len(block), 2 * DIMENSIONS), np.float32)
        full = np.flatnonzero(counts)
        if len(full):
            first = (np.cumsum(counts) - counts)[full]
            each = vectors[types]
            n = counts[full][:, None]
            mean = np.add.reduceat(each, first) / n
            made[full, :DIMENSIONS] = mean
            made[full, DIMENSIONS:] = np.sqrt(np.maximum(np.add.reduceat(each * each, first) / n - mean * mean, 0))
        out.append(made)
    return np.concatenate(out) if out else np.zeros((0, 2 * DIMENSIONS), np.float32)


class Network:
    """Two layers: tanh, then a logit; inputs are centred and scaled as in the rows it was fitted on."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        """Fits by Adam over all rows at each step, then the temperature on the rows kept apart."""
        rng = np.random.default_rng(1)
        apart = np.arange(len(rows)) % CALIBRATION == CALIBRATION - 1
        self.centre, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
        x, y = self._scaled(rows[~apart]), labels[~apart].astype(float)
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 512):
                some = order[at : at + 512]
                hidden = np.tanh(x[some] @ self.w[0] + self.w[1])
                error = (1 / (1 + np.exp(-(hidden @ self.w[2] + self.w[3]))) - y[some]) / len(some)
                back = np.outer(error, self.w[2]) * (1 - hidden * hidden)
                t += 1
                for p, g in enumerate((x[some].T @ back + DECAY * self.w[0], back.sum(axis=0), hidden.T @ error + DECAY * self.w[2], error.sum(keepdims=True))):
                    m[p] = 0.9 * m[p] + 0.1 * g
                    v[p] = 0.999 * v[p] + 0.001 * g * g
                    self.w[p] -= RATE * (m[p] / (1 - 0.9**t)) / (np.sqrt(v[p] / (1 - 0.999**t)) + 1e-8)
        if apart.any():
            logits, kept = self._logits(rows[apart]), labels[apart]
            tries = np.geomspace(0.25, 8, 60)
            losses = [np.logaddexp(0, np.where(kept == 1, -logits, logits) / t).mean() for t in tries]
            self.temperature = float(tries[int(np.argmin(losses))])

    def _scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.scale, -8, 8)

    def _logits(self, rows: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(rows) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(rows) / self.temperature, -30, 30)))


def _fold(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 3; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def quality_scores(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Scores every whole text of docs(doc_id, text) for quality, learnt from labels(doc_id, quality).

    Labels of rows whose CRC-32 of the id leaves 1 modulo 3 are held out.
    Returns doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).
    Null, empty and blank texts pool to zeros and get the score of that. A null
    id joins no label. An id with several labels counts as their greatest.
    Rows with null quality are no labels. Without labels of both kinds every
    score is the share of 1 among the labels, or 0.5 without any. Repeated rows
    get equal scores; an empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    vectors = word_vectors(docs)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = pooled(pdf["text"].tolist(), vectors)
            if not len(made):
                continue
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "pooled": list(made)})

    base = docs.select(id_text().alias("doc_id"), text_or_empty().alias("text"))
    rows = written(base.mapInPandas(pool, "doc_id string, pooled array<float>").withColumn("doc_id", F.col("doc_id").cast("long")), "quality-pooled")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where(_fold(F.col("doc_id")) != 1)
    chosen = rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).toPandas()
    marks = chosen["quality"].to_numpy(int)
    if len(set(marks.tolist())) < 2:
        share = F.lit(float(marks.mean()) if len(marks) else 0.5)
        scored = rows.select("doc_id", share.alias("score"))
    else:
        network = Network(np.stack(chosen["pooled"].to_numpy()).astype(float), marks)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    made = np.stack(pdf["pooled"].to_numpy()).astype(float)
                    yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": network.probabilities(made)})

        scored = rows.withColumn("doc_id", id_text()).mapInPandas(score, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
    return scored.select("doc_id", (_fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
