"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into half-chunks that cover all of it; neighbouring halves form chunks that overlap by
half. Learned filters slide over the embedded bytes, each is max-pooled over a chunk, a chunk's pooled values give its
logit, and the mean of the chunks' logits gives the document's probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_chunks, text_or_empty

HALF, WIDTH, STRIDE, EMBED, FILTERS = 256, 8, 2, 4, 24
ROW = HALF + WIDTH - STRIDE
PAD = 256
CHUNK_BYTES = 4 << 20
#: Half-chunks that go through the filters at once (about 5 MB).
BLOCK = 256


@dataclass(frozen=True)
class Sample:
    """Bounds of the labelled rows that the model is fitted on: so many of either label, so many bytes of each."""

    per_label: int = 1000
    max_bytes: int = 16384
    epochs: int = 10
    batch: int = 16
    rate: float = 0.02
    seed: int = 7
    #: Share of the label 1 texts of an epoch that are cut to a random short length: a short text is not a bad one.
    crops: float = 0.2
    crop_bytes: tuple[int, int] = (4, 300)


@dataclass
class Model:
    embed: np.ndarray = field(default_factory=lambda: np.zeros((257, EMBED), np.float32))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH * EMBED, FILTERS), np.float32))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS, np.float32))
    bias: float = 0.0
    prior: float = 0.0  # log-odds of label 1 among labelled rows, less those of the sample


def halves(data: bytes) -> np.ndarray:
    """Half-chunks of a text as rows of byte numbers, each with the bytes that its last filter positions reach into."""
    n = max(1, -(-len(data) // HALF))
    padded = np.full(n * HALF + ROW - HALF, PAD, dtype=np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, ROW), (HALF * padded.itemsize, padded.itemsize))


def _unrolled(model: Model, rows: np.ndarray) -> np.ndarray:
    embedded = model.embed[rows]  # (n, ROW, EMBED)
    n, s = len(rows), embedded.strides
    positions = (ROW - WIDTH) // STRIDE + 1
    view = np.lib.stride_tricks.as_strided(embedded, (n, positions, WIDTH * EMBED), (s[0], s[1] * STRIDE, s[2]))
    return np.ascontiguousarray(view)


def pooled(model: Model, rows: np.ndarray) -> np.ndarray:
    """Each filter's greatest value over each half-chunk."""
    out = np.empty((len(rows), FILTERS), np.float32)
    for at in range(0, len(rows), BLOCK):
        x = _unrolled(model, rows[at : at + BLOCK])
        out[at : at + BLOCK] = (x.reshape(-1, WIDTH * EMBED) @ model.filters).reshape(len(x), -1, FILTERS).max(axis=1)
    return out


def logit(model: Model, best: np.ndarray) -> float:
    """From the pooled values of a text's half-chunks."""
    chunks = np.maximum(best[:-1], best[1:]) if len(best) > 1 else best
    return float((np.maximum(chunks + model.shift, 0) @ model.weights).mean()) + model.bias + model.prior


def probability(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def train(texts: list[bytes], labels: list[int], sample: Sample = Sample(), counts: tuple[float, float] | None = None) -> Model:
    """counts: rows of label 0 and 1 that the sample stands for. With rows of one label only, the prior decides."""
    n1 = sum(labels)
    n0 = len(labels) - n1
    c0, c1 = counts or (n0, n1)
    if not n0 or not n1:
        return Model(prior=float(np.log((c1 + 0.5) / (c0 + 0.5))))
    rng = np.random.Generator(np.random.PCG64(sample.seed))
    normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    m = Model(normal(257, EMBED), normal(WIDTH * EMBED, FILTERS) / np.sqrt(WIDTH * EMBED), np.zeros(FILTERS, np.float32), 0.3 * normal(FILTERS))
    m.prior = float(np.log(c1 / c0) - np.log(n1 / n0)) if c0 and c1 else 0.0
    moments = {k: [0.0, 0.0] for k in ("embed", "filters", "shift", "weights", "bias")}
    rows = [halves(t) for t in texts]
    step = 0
    for epoch in range(sample.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), sample.batch):
            picked = order[at : at + sample.batch]
            step += 1
            grads = {"embed": np.zeros_like(m.embed), "filters": np.zeros_like(m.filters), "shift": np.zeros_like(m.shift), "weights": np.zeros_like(m.weights), "bias": 0.0}
            for k in picked:
                cut = labels[k] and rng.random() < sample.crops
                _add_gradient(m, halves(texts[k][: rng.integers(*sample.crop_bytes)]) if cut else rows[k], labels[k], grads)
            rate = sample.rate * (1 - epoch / sample.epochs)
            for name, g in grads.items():
                g = g / len(picked)
                a, b = moments[name]
                moments[name] = [a, b] = [0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g]
                setattr(m, name, getattr(m, name) - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6))
            m.embed, m.filters = m.embed.astype(np.float32), m.filters.astype(np.float32)
    m.bias = float(m.bias)
    return m


def _add_gradient(m: Model, rows: np.ndarray, label: int, grads: dict) -> None:
    n = len(rows)
    x = _unrolled(m, rows)
    z = (x.reshape(-1, WIDTH * EMBED) @ m.filters).reshape(n, -1, FILTERS)
    where = z.argmax(axis=1)
    best = np.take_along_axis(z, where[:, None, :], axis=1)[:, 0]
    if n > 1:
        from_next = best[1:] > best[:-1]
        chunks = np.where(from_next, best[1:], best[:-1])
        source = np.arange(n - 1)[:, None] + from_next
    else:
        chunks, source = best, np.zeros((1, FILTERS), np.int64)
    act = np.maximum(chunks + m.shift, 0)
    p = probability(float((act @ m.weights).mean()) + m.bias)
    d = (p - label) / len(chunks)
    grads["bias"] += p - label
    grads["weights"] += d * act.sum(axis=0)
    back = np.where(act > 0, d * m.weights, 0).astype(np.float32)  # (chunks, FILTERS)
    grads["shift"] += back.sum(axis=0)
    filters = np.broadcast_to(np.arange(FILTERS), source.shape)
    at = where[source, filters]
    seen = x[source, at]  # (chunks, FILTERS, WIDTH * EMBED)
    grads["filters"] += np.einsum("cf,cfk->kf", back, seen)
    to_bytes = back[:, :, None] * m.filters.T[None]  # (chunks, FILTERS, WIDTH * EMBED)
    byte_at = rows[source[:, :, None], (at * STRIDE)[:, :, None] + np.arange(WIDTH)]
    np.add.at(grads["embed"], byte_at.reshape(-1), to_bytes.reshape(-1, EMBED))


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on a bounded sample of labels (already without held-out rows): the per_label ids of either label that hash
    lowest. An id counts once: of its labels the lower one is taken, of its rows one, so that 2 * per_label rows are
    collected at most. Of a text over max_bytes a window is taken, at a place that its id's hash decides. Rows with a null id or a
    label other than 0 or 1 take no part; the prior follows the labels whose documents exist, as the sample shows them."""
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    usable = usable.groupBy("id").agg(F.min("label").alias("label"))  # an id has one label, however often it is there
    found = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    # 2 * per_label ids at most: broadcast, so that no text is shuffled
    picked = [r for k in (0, 1) for r in usable.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample.per_label).collect()]
    ids = spark.createDataFrame(picked, usable.schema)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    width = sample.max_bytes // 4  # characters, of four bytes at most
    start = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.length("text") - width + 1)).cast("int") + 1
    window = F.when(F.octet_length("text") <= sample.max_bytes, F.col("text")).otherwise(F.col("text").substr(start, F.lit(width)))
    rows = texts.join(F.broadcast(ids), "id").select("id", window.cast("binary").alias("text"), "label").groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (str(r["id"]), bytes(r["text"]), r["label"]))
    there = {r["id"] for r in rows}
    share = {k: sum(r["id"] in there for r in picked if r["label"] == k) / max(1, sum(r["label"] == k for r in picked)) for k in (0, 1)}
    return train([bytes(r["text"]) for r in rows], [r["label"] for r in rows], sample, (found.get(0, 0) * share[0], found.get(1, 0) * share[1]))


def score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a column more: the probability of label 1 for the whole text. A null text scores as an empty one. No
    shuffle; other columns pass through untouched, but one with that name is replaced."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    own = docs.schema[text_col].dataType == StringType() and text_col != name
    kept = docs.drop(name)
    # a text that is a string goes to Python once, and is scored from there
    rows = kept if own else docs.withColumn(name, text_or_empty(text_col))
    source, names = text_col if own else name, kept.columns
    schema = StructType([*kept.schema.fields, StructField(name, DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_chunks(batches, source, CHUNK_BYTES):
            texts = batch.column(source)
            large = pa.types.is_large_string(texts.type)
            own = [halves(t or b"") for t in texts.cast(pa.large_binary() if large else pa.binary()).to_pylist()]
            ends = np.cumsum([len(x) for x in own])
            best = pooled(model, np.concatenate(own))
            out = [probability(logit(model, b)) for b in np.split(best, ends[:-1])]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(out, pa.float64())], names=[*names, name])

    return rows.mapInArrow(scored, schema)
