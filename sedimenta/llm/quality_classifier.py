"""A quality classifier by co-training: one view of a page's text, one of its metadata."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import buffers, slices, word_hashes

#: Classes of byte trigrams in the text view; of sources and languages in the metadata view.
TRIGRAMS, SOURCES, LANGS = 2048, 32, 8
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#*$%&|<>!"]] = True
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in " \t\n\x0b\x0c\r"]] = True
SCHEMA = "doc_id long, p_text double, p_meta double, score double, kept boolean"


def text_view(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text the square roots of the shares of its byte trigrams' classes."""
    n = len(off) - 1
    out = np.zeros((n, TRIGRAMS), np.float32)
    if len(data) > 2:
        wide = data.astype(np.uint32)
        code = ((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(21)
        doc = np.repeat(np.arange(n), np.diff(off))[:-2]
        inside = np.arange(len(code)) + 3 <= off[doc + 1]
        out += np.bincount(doc[inside] * TRIGRAMS + code[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))


def meta_view(data: np.ndarray, off: np.ndarray, n_chars: np.ndarray, sources: list, langs: list) -> np.ndarray:
    """For each page numbers about it: source, language, size, lines, and how its letters, marks and words are spread."""
    n, size = len(off) - 1, np.diff(off).astype(np.float64)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off]) if len(data) else np.zeros(n)
    hashes, words = word_hashes(data, off)
    doc = np.repeat(np.arange(n), words)
    again = lambda k: np.bincount(doc[k:][(hashes[k:] == hashes[:-k]) & (doc[k:] == doc[:-k])], minlength=n)
    chars = np.where(n_chars >= 0, n_chars, size)
    lines = total(data == 10) + 1
    per = lambda x: x / np.maximum(size, 1)
    cols = [
        np.log1p(size), np.log1p(chars), per(chars), np.log1p(lines), np.log1p(words / lines), per(words * 1.0),
        per(total((data >= 65) & (data <= 90))), per(total((data >= 48) & (data <= 57))), per(total(_MARKS[data])), per(total((data == 46) | (data == 44))),
        per(total(_BREAKS[data])), again(1) / np.maximum(words, 1), again(2) / np.maximum(words, 1),
    ]
    hot = np.zeros((n, SOURCES + LANGS))
    hot[np.arange(n), [crc32((s or "\0").encode()) % SOURCES for s in sources]] = 1
    hot[np.arange(n), [SOURCES + crc32((x or "\0").encode()) % LANGS for x in langs]] = 1
    return np.column_stack([*cols, hot]).astype(np.float32)


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, text view, metadata view) of a batch (doc_id, text, source, lang, n_chars, ...)."""
    chars = batch.column(4).fill_null(-1).to_numpy(zero_copy_only=False)
    sources, langs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    for a, b, data, off in slices(*buffers(batch.column(1))):
        yield a, b, text_view(data, off), meta_view(data, off, chars[a:b], sources[a:b], langs[a:b])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 12) -> np.ndarray:
    """Weights of a logistic regression with an intercept (last), by Newton steps solved with conjugate gradients."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    shrink = np.full(x.shape[1], penalty)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w.astype(x.dtype)).astype(np.float64)
        grad = x.T @ (p - y).astype(x.dtype) + shrink * w
        curve = np.maximum(p * (1 - p), 1e-4)
        d, r = np.zeros_like(w), -grad
        q, rr = r.copy(), float(r @ r)
        limit = 1e-4 * rr
        for _ in range(30):
            if rr <= limit:
                break
            h = x.T @ (curve * (x @ q.astype(x.dtype))).astype(x.dtype) + shrink * q
            step = rr / float(q @ h)
            d += step * q
            r -= step * h
            new = float(r @ r)
            q, rr = r + new / rr * q, new
        w += d
        if np.abs(d).max() < 1e-3:
            break
    return w


@dataclass
class Model:
    """Weights of both views, means and deviations of the metadata, and how the views' margins make a score."""

    text: np.ndarray
    meta: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    platt: np.ndarray  # of text, of metadata, of both

    def margins(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        meta = (meta - self.mean) / self.deviation
        own = lambda x, w: (x * w[:-1]).sum(1) + w[-1]  # noqa: E731  unlike a matrix product the same for equal rows
        return own(text, self.text), own(meta, self.meta)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.margins(text, meta)
        (t, t0), (m, m0), both = self.platt[0:2], self.platt[2:4], self.platt[4:7]
        return _sigmoid(t * a + t0), _sigmoid(m * b + m0), _sigmoid(both[0] * a + both[1] * b + both[2])


def cotrain(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = 3, sure: float = 0.97, share: float = 0.25, penalty: float = 0.02) -> Model:
    """A model from pages with label 1, 0 or (unlabelled) -1.

    A fifth of the labelled pages is put aside. In each round each view's classifier is fitted, and passes to the other
    view, as labels, the unlabelled pages that it is `sure` of: at most `share` of them a round, the surest of each
    class first, in the classes' proportion. Then each view's margin is calibrated on the pages put aside (Platt), and
    so is their combination.
    """
    known = np.flatnonzero(label >= 0)
    aside = known[::5]
    own = np.setdiff1d(known, aside)
    pool = np.flatnonzero(label < 0)
    mean, deviation = meta[own].mean(0), meta[own].std(0) + 1e-3
    flat = (meta - mean) / deviation
    views = (text * np.float32(8), flat)
    given: list[dict[int, int]] = [{}, {}]  # what each view got from the other
    rate = label[own].mean()

    def fitted(v: int) -> np.ndarray:
        rows = np.concatenate([own, np.fromiter(given[v], np.int64, len(given[v]))]).astype(np.int64)
        labels = np.concatenate([label[own], np.fromiter(given[v].values(), np.int64, len(given[v]))])
        return logistic(views[v][rows], labels.astype(np.float64), penalty * len(rows) / 100)

    weights = [fitted(0), fitted(1)]
    for _ in range(rounds if len(pool) else 0):
        most = int(share * len(pool))
        for v in (0, 1):
            p = _sigmoid(views[v][pool] @ weights[v][:-1].astype(np.float32) + weights[v][-1])
            for value, chance, quota in ((1, p, int(most * rate)), (0, 1 - p, int(most * (1 - rate)))):
                best = pool[np.argsort(-chance, kind="stable")[:quota]]
                at = np.searchsorted(pool, best)
                given[1 - v].update((int(i), value) for i in best[chance[at] >= sure])
        weights = [fitted(0), fitted(1)]
    weights[0][:-1] *= 8
    model = Model(weights[0], weights[1], mean, deviation, np.zeros(7))
    a, b = model.margins(text[aside], meta[aside])
    y = label[aside].astype(np.float64)
    model.platt = np.concatenate([logistic(x.astype(np.float64), y, 1e-2, 50) for x in (a[:, None], b[:, None], np.column_stack([a, b]))])
    return model


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 4000, unlabelled: int = 4000, **options) -> Model | None:
    """A model from at most `labelled` and `unlabelled` documents, those least by a hash of doc_id; None without both classes.

    The views of the sample, a bounded number of rows, meet in one task, which fits; the driver gets the weights alone.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    marked = marked.select("doc_id", (F.col("q") >= 0.5).cast("int").alias("label"))
    first = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    others = docs.select("doc_id").where("doc_id IS NOT NULL").join(marked, "doc_id", "left_anti").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    sample = F.broadcast(first.union(others.select("doc_id", F.lit(-1))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")).join(sample, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text, meta in _views(batch):
                views = [[x.tobytes() for x in v] for v in (text.astype(np.float16), meta)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(5).slice(a, b - a), *[pa.array(v, pa.binary()) for v in views]], names=["doc_id", "label", "text", "meta"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _fitted(pa.Table.from_batches(list(batches), schema=schema), **options)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)] if model else [], pa.binary())], names=["model"])

    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("text", pa.binary()), ("meta", pa.binary())])
    sampled = rows.mapInArrow(run, "doc_id long, label int, text binary, meta binary").dropDuplicates(["doc_id"])
    got = sampled.repartition(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else None


def _fitted(got: pa.Table, **options) -> Model | None:
    """A model from the sample (doc_id, label, text, meta)."""
    got = got.sort_by("doc_id")
    label = got.column("label").to_numpy().astype(np.int64)
    if not {0, 1} <= set(label[label >= 0][::5].tolist()) or len(set(np.delete(label[label >= 0], slice(None, None, 5)).tolist())) < 2:
        return None
    matrix = lambda c, t: np.frombuffer(b"".join(got.column(c).to_pylist()), t).reshape(len(label), -1).astype(np.float32)
    return cotrain(matrix("text", np.float16), matrix("meta", np.float32), label, **options)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5, whole_rows: bool = False) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) for each row, with whole_rows also the row; all 0.5 and kept without a model."""
    whole = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), *whole)
    half = F.lit(0.5)
    if model is None:
        return rows.select("doc_id", half.alias("p_text"), half.alias("p_meta"), half.alias("score"), F.lit(True).alias("kept"), *(["row"] if whole_rows else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = SCHEMA + "".join(f", row {f.dataType.simpleString()}" for f in rows.schema if f.name == "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(text, meta) for _, _, text, meta in _views(batch)]
            p = [np.concatenate([x[i] for x in parts]).astype(np.float64) if parts else np.zeros(0) for i in range(3)]
            out = [batch.column(0), *map(pa.array, p), pa.array(p[2] >= threshold), *batch.columns[5:]]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "p_text", "p_meta", "score", "kept", "row"][: len(out)])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, whole_rows: bool = False, **options) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) for each row of docs(doc_id, text, source, lang, n_chars).

    fit() trains on a bounded sample, `labelled` and `unlabelled` documents of the hash order of doc_id; every document
    is scored, whole, in one pass without a shuffle. score is the calibrated probability of quality 1 from both views.

    Null text is an empty page, null source and lang are classes of their own, null n_chars counts as the bytes. A null
    doc_id is scored but not in the sample; labels with nulls don't count; several labels of a document count as their
    mean; labels without documents are ignored. Equal rows get equal scores. Without labels of both classes all scores
    are 0.5 and everything is kept. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return score(docs, fit(docs, labels, **options), threshold, whole_rows)
