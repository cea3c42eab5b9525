"""Quality scores by nearest-neighbour voting in a latent-semantic space.

The terms of a text are its pairs of neighbouring character classes (letters,
digits, each punctuation mark, ...) and word repetitions.  A singular value
decomposition of a bounded labelled sample gives the latent space.  The
labelled vectors are broadcast, every document is compared with all of them
in exact blocked cosine products, and the labels of its nearest neighbours
vote with their similarity as weight.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import task, text_slices, word_hashes

SAMPLE_PER_LABEL = 2000  # labelled rows of each label that the model is fitted on, at most
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8  # the similarity's power in a vote
BLOCK = 256  # documents compared at once

_CLASS = np.full(256, 5, dtype=np.int64)  # non-ASCII
_CLASS[:33] = 6  # control
_CLASS[[32, 10]] = 3, 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_MARKS = [b for b in range(33, 128) if not chr(b).isalnum()]
_CLASS[_MARKS] = 7 + np.arange(len(_MARKS))
_N = 7 + len(_MARKS)
_REPEATS = 3
TERMS = _N * _N + _REPEATS


def term_weights(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of damped term shares for each text of a slice."""
    rows = len(offs) - 1
    out = np.zeros((rows, TERMS), dtype=np.float64)
    if len(data) > 1:
        c = _CLASS[data]
        pair = c[:-1] * _N + c[1:]
        row = np.repeat(np.arange(rows), np.diff(offs))
        same = row[:-1] == row[1:]
        grid = np.bincount(row[:-1][same] * (_N * _N) + pair[same], minlength=rows * _N * _N)
        out[:, : _N * _N] = grid.reshape(rows, -1)
        out[:, : _N * _N] /= np.maximum(np.diff(offs), 1)[:, None]
        h, at = word_hashes(data, offs)
        words = np.maximum(np.bincount(at, minlength=rows), 1)
        for k in (1, 2):  # words equal to the one k before
            if len(h) > k:
                again = (h[k:] == h[:-k]) & (at[k:] == at[:-k])
                out[:, _N * _N + k - 1] = np.bincount(at[k:][again], minlength=rows) / words
        order = np.lexsort((h, at))
        seen = (h[order][1:] == h[order][:-1]) & (at[order][1:] == at[order][:-1]) if len(h) else np.zeros(0, bool)
        # repeats beyond what a text of its length has by common words
        out[:, _N * _N + 2] = np.maximum(0, np.bincount(at[order][1:][seen], minlength=rows) / words - 0.1 * np.log10(words + 1)) if len(h) > 1 else 0
    return np.log1p(1000 * out).astype(np.float32)


def _terms(text: str, key: str):
    @task
    def run(batches):
        for batch in batches:
            label = batch.column(batch.schema.get_field_index(key))
            for i, j, data, offs in text_slices(batch.column(batch.schema.get_field_index(text)), 1 << 19, BLOCK):
                x = term_weights(data, offs)
                yield pa.RecordBatch.from_arrays([label.slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=[key, "terms"])

    return run


def _fitted(dimensions: int):
    """The model of all rows, in one task: they are a bounded sample."""

    @task
    def run(batches):
        rows = sorted((k, t) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        terms = np.frombuffer(b"".join([t for _, t in rows]), np.float32).reshape(-1, TERMS)
        model = Model(terms, np.array([int(k[-1]) for k, _ in rows]), dimensions)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())], names=["model"])

    return run


class Model:
    """Latent space and labelled vectors; with one label or none it has no
    vectors and gives every text the same score."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, dimensions: int):
        self.constant = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        if len(set(labels.tolist())) > 1:
            self.mean = terms.mean(axis=0)
            centred = terms - self.mean
            # the right singular vectors, from the small square of the terms
            _, v = np.linalg.eigh((centred.T @ centred).astype(np.float64))
            self.axes = np.ascontiguousarray(v[:, ::-1][:, :dimensions].astype(np.float32))
            self.vectors = self.latent(terms)

    def latent(self, terms: np.ndarray) -> np.ndarray:
        z = (terms - self.mean) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
        if not hasattr(self, "vectors"):
            return np.full(len(terms), self.constant)
        z, out = self.latent(terms), np.zeros(len(terms))
        k = min(neighbours, len(self.labels))
        for i in range(0, len(z), BLOCK):
            near = z[i : i + BLOCK] @ self.vectors.T
            top = np.argpartition(near, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-3).astype(np.float64) ** sharpness
            out[i : i + BLOCK] = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_per_label: int = SAMPLE_PER_LABEL, dimensions: int = DIMENSIONS) -> Model:
    """Fit on at most ``sample_per_label`` labelled rows of each label,
    chosen by a hash of the id, none of them held out.  Of the rows that repeat
    an id, the text with the smallest hash is used."""
    known = labels.select(F.col(doc_id), F.col(label).cast("int").alias("label")).filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    order = F.xxhash64(doc_id)
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(order, doc_id).limit(sample_per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = chosen.select(doc_id).distinct()
    one = docs.select(doc_id, text).join(F.broadcast(ids), doc_id).groupBy(doc_id).agg(F.min(F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text"))).alias("own"))
    rows = one.join(F.broadcast(chosen), doc_id).select(F.concat_ws("|", doc_id, "label").alias("key"), F.col("own.text").alias(text))
    fitted = rows.mapInArrow(_terms(text, "key"), "key string, terms binary").repartition(1).mapInArrow(_fitted(dimensions), "model binary").head()
    model = Model.__new__(Model)
    model.__dict__.update(pickle.loads(fitted[0]) if fitted else vars(Model(np.zeros((0, TERMS), np.float32), np.zeros(0), dimensions)))
    return model


def _score(sent, text: str, neighbours: int, sharpness: float):
    @task
    def run(batches):
        model = Model.__new__(Model)
        model.__dict__.update(sent.value)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, offs in text_slices(batch.column(batch.schema.get_field_index(text)), 1 << 19, BLOCK):
                out[i:j] = model.score(term_weights(data, offs), neighbours, sharpness)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS, sample_per_label: int = SAMPLE_PER_LABEL, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` with held_out, score and predicted added, one row per row.

    Only whole texts are inputs.  Null text counts as empty and is scored like
    any other.  Null or other labels, and labels without a document, are left
    out; labels of repeated ids each vote, with one of the id's texts.  Without labels of both kinds every
    score is the mean label, or 0.5.  Columns of ``docs`` named like a result
    are replaced by it.
    """
    model = fit(docs, labels, doc_id=doc_id, text=text, label=label, sample_per_label=sample_per_label, dimensions=dimensions)
    base = docs.drop("held_out", "score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # 2 * sample_per_label vectors and the axes
    out = base.mapInArrow(_score(sent, text, neighbours, sharpness), f"{fields}, score double")
    return out.withColumn("held_out", held_out(doc_id)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
