"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of 512 that start every 384 bytes, so chunks overlap and cover the
whole text. Learned filters over 5 bytes run along every chunk, each filter's largest response in the chunk is
kept, and the text is judged by the mean, the largest and the smallest of these over its chunks and by its
length: one hidden layer, one probability.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0. The network is fitted on a bounded
sample of them: ``sample_rows`` rows by the order of a hash, and for fitting at most ``sample_chunks`` chunks
a text, evenly spread. Scoring always covers the whole text, within the scan: no shuffle.

Defined results: null and empty texts are one chunk of zero bytes and get its score; without any label of both
kinds the score is the share of good labels (0.5 without labels); repeated rows are scored one by one; equal
texts get equal scores; extra columns pass through ``keep_good``; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, small_batches, utf8

CHUNK, STEP, PART, WIDTH, FILTERS, HIDDEN = 512, 384, 128, 5, 16, 16
THRESHOLD = 0.3
SEED = 5


def pairs(filters: np.ndarray) -> list[np.ndarray]:
    """The filters as tables over byte pairs (0, 1), (2, 3) and over the last byte."""
    return [(filters[j][:, None] + filters[j + 1][None]).reshape(65536, -1) for j in (0, 2)] + [filters[4]]


def respond(tables: list[np.ndarray], data: np.ndarray) -> np.ndarray:
    """Responses of all filters at each place of ``data`` (last axis) that has five bytes."""
    n = data.shape[-1] - WIDTH + 1
    wide = data.astype(np.intp)
    both = wide[..., :-1] * 256 + wide[..., 1:]
    out = np.take(tables[0], both[..., :n], axis=0, mode="clip")
    out += np.take(tables[1], both[..., 2 : n + 2], axis=0, mode="clip")
    out += np.take(tables[2], wide[..., 4 : n + 4], axis=0, mode="clip")
    return out


def chunk_starts(size: int) -> np.ndarray:
    return np.arange(0, max(size - (CHUNK - STEP), 1), STEP)


def describe(top: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row for each text from its chunks' responses (``first`` chunk of each text, sizes in bytes)."""
    count = np.diff(np.append(first, len(top)))[:, None]
    length = np.log1p(sizes)[:, None] / 8
    return np.concatenate([np.add.reduceat(top, first) / count, np.maximum.reduceat(top, first), np.minimum.reduceat(top, first), length, length**2], axis=1)


def head(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ model["w1"] + model["b1"])
    return h, 1 / (1 + np.exp(-np.clip(h @ model["w2"] + model["b2"], -30, 30)))


def sampled(text: bytes, sample_chunks: int = 8) -> tuple[int, bytes]:
    """The size of a text and those of its chunks that the fit uses, each with the bytes that filters reach beyond it."""
    starts = chunk_starts(len(text))
    starts = starts[np.unique(np.linspace(0, len(starts) - 1, sample_chunks).astype(int))]
    return len(text), b"".join(text[a : a + CHUNK + WIDTH - 1].ljust(CHUNK + WIDTH - 1, b"\0") for a in starts.tolist())


def fit(texts: list[bytes], labels: np.ndarray, sample_chunks: int = 8, **how) -> dict:
    return fit_sampled([sampled(t, sample_chunks) for t in texts], labels, sample_chunks, **how)


def fit_sampled(texts: list[tuple[int, bytes]], labels: np.ndarray, sample_chunks: int = 8, epochs: int = 10, rate: float = 0.01) -> dict:
    """Adam on the log loss; only the places of the largest responses pass gradients to the filters."""
    rng = np.random.default_rng(SEED)
    wide = 3 * FILTERS + 2
    model = {
        "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
        "w1": rng.normal(0, wide**-0.5, (wide, HIDDEN)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32), "w2": rng.normal(0, 0.25, HIDDEN).astype(np.float32), "b2": np.zeros(1, np.float32),
    }
    chunks, beyond, counts = [], [], []
    for size, data in texts:
        starts = chunk_starts(size)
        starts = starts[np.unique(np.linspace(0, len(starts) - 1, sample_chunks).astype(int))]
        chunks.append(np.frombuffer(data, np.uint8).reshape(-1, CHUNK + WIDTH - 1))
        beyond.append(starts[:, None] + np.arange(CHUNK) >= max(size, 1))
        counts.append(len(starts))
    sizes = np.array([size for size, _ in texts], np.float32)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    t = 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs) + rate / 20
        order = rng.permutation(len(texts))
        for part in np.array_split(order, max(1, len(order) // 32)):
            x8 = np.concatenate([chunks[i] for i in part])
            n = np.array([counts[i] for i in part])
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            out = respond(pairs(model["filters"]), x8)
            out[np.concatenate([beyond[i] for i in part])] = -1e9
            at = out.argmax(axis=1)
            raw = np.take_along_axis(out, at[:, None], axis=1)[:, 0] + model["bias"]
            top = np.maximum(raw, 0)
            x = describe(top, first, sizes[part])
            h, p = head(model, x)
            dz = ((p - labels[part]) / len(part)).astype(np.float32)
            grad = {"w2": h.T @ dz, "b2": dz.sum(keepdims=True)}
            dh = dz[:, None] * model["w2"] * (1 - h**2)
            grad["w1"], grad["b1"] = x.T @ dh, dh.sum(axis=0)
            dx = dh @ model["w1"].T
            text_of = np.repeat(np.arange(len(part)), n)
            mean, high, low = dx[:, :FILTERS], dx[:, FILTERS : 2 * FILTERS], dx[:, 2 * FILTERS : 3 * FILTERS]
            dtop = (mean / n[:, None])[text_of] + high[text_of] * (top == x[text_of, FILTERS : 2 * FILTERS]) + low[text_of] * (top == x[text_of, 2 * FILTERS : 3 * FILTERS])
            draw = np.where(raw > 0, dtop, 0.02 * dtop)  # a little passes filters that are silent everywhere
            grad["bias"] = draw.sum(axis=0)
            grad["filters"] = np.zeros_like(model["filters"])
            f = np.arange(FILTERS)
            for j in range(WIDTH):
                np.add.at(grad["filters"][j], (np.take_along_axis(x8, at + j, axis=1), f), draw)
            t += 1
            for k, g in grad.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model[k] -= (lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def score(model: dict, data: np.ndarray, offsets: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """The probability of each text of a batch, over all its bytes. Responses are taken once at each place and
    reduced to parts of 128 places; a chunk is four parts, of which it shares one with the next."""
    sizes = np.diff(offsets)
    places = np.maximum(sizes, 1)
    gap = WIDTH  # zero bytes after each text: no window reaches into the next one
    begin = np.concatenate([[0], np.cumsum(places + gap)])
    padded = np.zeros(begin[-1] + gap, np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    padded[np.arange(len(data)) - offsets[:-1][row] + begin[:-1][row]] = data
    parts = -(-places // PART)
    first = np.concatenate([[0], np.cumsum(parts)])
    row = np.repeat(np.arange(len(sizes)), parts)
    start = begin[row] + (np.arange(first[-1]) - first[row]) * PART
    end = np.minimum(start + PART, begin[row] + places[row])
    tables = pairs(model["filters"])
    top = np.empty((len(start), FILTERS), np.float32)
    i = 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + at_once, "right")), i + 1)
        out = respond(tables, padded[start[i] : end[j - 1] + WIDTH - 1])
        # between two texts a stretch of places belongs to neither: it is cut off as a part of its own
        edges = np.stack([start[i:j], end[i:j]], axis=1).ravel() - start[i]
        keep = np.append(np.diff(edges) > 0, edges[-1] < len(out))
        reduced = np.maximum.reduceat(out, edges[keep])
        top[i:j] = reduced[np.cumsum(keep)[::2] - 1]
        i = j
    chunks = np.array([len(chunk_starts(int(n))) for n in sizes])
    begins = np.concatenate([[0], np.cumsum(chunks)])
    row = np.repeat(np.arange(len(sizes)), chunks)
    at = first[row] + (np.arange(begins[-1]) - begins[row]) * (STEP // PART)
    four = [top[np.minimum(at + k, first[row + 1] - 1)] for k in range(CHUNK // PART)]
    whole = np.maximum(np.maximum.reduce(four) + model["bias"], 0)
    return head(model, describe(whole, begins[:-1], sizes.astype(np.float32)))[1].astype(np.float64)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def fit_on(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, **how) -> dict | float:
    """The network fitted on ``sample_rows`` labelled rows that are not held out, chosen by a hash; of each text
    only the chunks that the fit uses come to the driver, about 4 KB. A constant where the labels are all of one kind."""
    rule = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & rule).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows
    schema = pa.schema([("quality", pa.int32()), ("size", pa.int64()), ("chunks", pa.binary())])

    def run(batches):
        for batch in small_batches(batches):
            cut = [sampled((t or "").encode(), how.get("sample_chunks", 8)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in cut], pa.int64()), pa.array([c for _, c in cut], pa.binary())], schema=schema)

    ordered = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").select(F.col("quality").cast("int").alias("quality"), "text")
    got = list(ordered.mapInArrow(run, "quality int, size long, chunks binary").toLocalIterator())
    texts, marks = [(r.size, bytes(r.chunks)) for r in got], [r.quality for r in got]
    if len(set(marks)) < 2:
        return float(np.mean(marks)) if marks else 0.5
    return fit_sampled(texts, np.array(marks, np.float32), **how)


def _scores(model: dict | float, column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    return np.full(len(offsets) - 1, model) if isinstance(model, float) else score(model, data, offsets)


def score_quality(docs: DataFrame, model: dict | float, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs (doc_id, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in small_batches(batches):
            s = _scores(model, batch.column(1))
            held = pa.array([held_out(i) for i in batch.column(0).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), held, pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, columns unchanged."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in small_batches(batches):
            yield batch.filter(pa.array(_scores(model, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
