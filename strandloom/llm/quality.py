"""Quality classification by co-training.

Two views of a document are classified apart: its text (classes of neighbouring characters,
hashed words, repetition) and its page metadata (source, language, stated length).  In each round
both classifiers label all documents, and what one is confident of becomes training
data of the other: Spark sums the other's gradient over all of them, a table of fixed size, and
the step is taken on the driver.  Both are then calibrated on labelled rows kept apart, and the
calibrated views are combined to score all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.memory import give_back, given_back
from strandloom.llm.words import block_words, text_blocks
from strandloom.session import saved

#: Bound on the labelled rows that the classifiers are fitted on.
FIT_ROWS = 8000
#: Rounds of exchange, gradient steps in each, and from which probability a view labels for the other.
ROUNDS, STEPS, CONFIDENT = 3, 3, 0.97
#: What all pseudo-labels together count, as a share of the labelled rows.
SHARE = 0.5
#: Documents are rejected below this combined probability of good quality.
KEEP = 0.5
WORD_BUCKETS = 256
_SOURCES, _LANGS, _LENGTHS, _BOTH = 64, 16, 40, 128
_CLASSES = 12
_CLASS = np.full(256, 9, np.uint8)  # other ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[32, 9]], _CLASS[[10, 13]] = 4, 5
for _k, _marks in enumerate((b".,;:?", b"!", b"|", b"#$%&*@^~=+<>"), 6):
    _CLASS[list(_marks)] = _k if _k < 9 else 10
_CLASS[list(b"'\"()-")] = 11
TEXT_DIM = _CLASSES * _CLASSES + WORD_BUCKETS + 4
META_DIM = _SOURCES + _LANGS + _LENGTHS + _BOTH
_ROWS = 512


def _one_hot(out: np.ndarray, at: int, index: np.ndarray) -> None:
    out[np.arange(len(out)), at + index] = 1


def _length_bucket(x: np.ndarray) -> np.ndarray:
    return np.minimum((np.log2(np.maximum(x, 0) + 1) * 2).astype(np.int64), _LENGTHS - 1)


def _name_bucket(column: pa.Array, size: int) -> np.ndarray:
    return np.array([zlib.crc32((v or "").encode()) % size for v in column.to_pylist()], np.int64)


def features(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, text view, metadata view) for rows with text, source, lang, n_chars."""
    source, lang = _name_bucket(batch["source"], _SOURCES), _name_bucket(batch["lang"], _LANGS)
    stated = np.nan_to_num(batch["n_chars"].cast(pa.float64()).to_numpy(zero_copy_only=False))
    for begin in range(0, batch.num_rows, _ROWS):
        for at, to, raw, offsets in text_blocks(batch["text"].slice(begin, _ROWS)):
            n, size = to - at, np.diff(offsets)
            text, meta = np.zeros((n, TEXT_DIM), np.float32), np.zeros((n, META_DIM), np.float32)
            kind, doc = _CLASS[raw].astype(np.int64), np.repeat(np.arange(n), size)
            same = doc[1:] == doc[:-1]
            pair = (doc[1:] * _CLASSES * _CLASSES + kind[1:] * _CLASSES + kind[:-1])[same]
            pairs = np.bincount(pair, minlength=n * _CLASSES ** 2).reshape(n, -1)
            text[:, :_CLASSES ** 2] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1)) * 3
            words, first = block_words(raw, offsets)
            count, owner = np.diff(first), np.repeat(np.arange(n), np.diff(first))
            bucket = (words % np.uint64(WORD_BUCKETS)).astype(np.int64)
            hashed = np.log1p(np.bincount(owner * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, -1))
            text[:, _CLASSES ** 2:-4] = hashed / np.maximum(np.linalg.norm(hashed, axis=1, keepdims=True), 1e-9)
            again = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
            own = np.unique(owner.astype(np.uint64) * np.uint64(1 << 40) + (words >> np.uint64(24)))
            distinct = np.bincount((own >> np.uint64(40)).astype(np.int64), minlength=n)
            some = np.maximum(count, 1)
            text[:, -4:] = np.stack([again / some, distinct / some, np.minimum(size / some, 40) / 10, count == 0], axis=1)
            rows = slice(begin + at, begin + to)
            length = _length_bucket(stated[rows])
            _one_hot(meta, 0, source[rows])
            _one_hot(meta, _SOURCES, lang[rows])
            _one_hot(meta, _SOURCES + _LANGS, length)
            _one_hot(meta, _SOURCES + _LANGS + _LENGTHS, (source[rows] * 37 + length) % _BOTH)
            yield begin + at, begin + to, text, meta


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps with a ridge on all but the constant."""
    x = np.c_[x, np.ones(len(x), x.dtype)].astype(np.float64)
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ beta)
        w = weight * np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def logit(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1].astype(x.dtype) + beta[-1]


@dataclass(frozen=True)
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray  # calibrations: slope and constant
    meta_scale: np.ndarray
    blend: np.ndarray  # of the two calibrated log odds

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: combined, text and metadata probability of good quality."""
        a = logit(logit(text, self.text)[:, None].astype(np.float64), self.text_scale)
        b = logit(logit(meta, self.meta)[:, None].astype(np.float64), self.meta_scale)
        return np.stack([_sigmoid(np.c_[a, b] @ self.blend[:-1] + self.blend[-1]), _sigmoid(a), _sigmoid(b)], axis=1)


def step(x: np.ndarray, y: np.ndarray, beta: np.ndarray, pulled: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """One step on the labelled rows and ``pulled``, the gradient that the pseudo-labels add.

    The curvature of the labelled rows, scaled by what all rows count, stands for that of all.
    """
    p = _sigmoid(logit(x, beta))
    x = np.c_[x, np.ones(len(x), x.dtype)].astype(np.float64)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.maximum(p * (1 - p), 1e-4) * (1 + SHARE * pulled.any())
    return beta + np.linalg.solve((x * w[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) + pulled - penalty * beta)


def pulls(pool: DataFrame, givers: list[np.ndarray], betas: list[np.ndarray]) -> list[np.ndarray]:
    """For each view the mean gradient over all rows of ``pool`` that the other view labels.

    ``givers`` are the classifiers that label, ``betas`` those that learn; rows are text and
    metadata views.  Tasks add up their rows, Spark adds the tasks' sums place by place.
    """
    shared = pool.sparkSession.sparkContext.broadcast((givers, betas))  # fixed size
    sizes = [len(b) + 1 for b in betas]  # the last place counts rows

    @given_back
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        givers, betas = shared.value
        total = [np.zeros(n) for n in sizes]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                views = [_unpacked(batch[c].slice(at, _ROWS)) for c in ("text", "meta")]
                for v in (0, 1):
                    given = _sigmoid(logit(views[1 - v], givers[1 - v]))
                    sure = (given >= CONFIDENT) | (given <= 1 - CONFIDENT)
                    x = views[v][sure].astype(np.float64)
                    miss = (given[sure] >= CONFIDENT) - _sigmoid(logit(x, betas[v]))
                    total[v][:-2] += x.T @ miss
                    total[v][-2] += miss.sum()
                    total[v][-1] += len(x)
        flat = np.concatenate(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "value"])

    sums = np.zeros(sum(sizes))
    for r in pool.mapInArrow(summed, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        sums[r["place"]] = r["value"]
    out = [sums[:sizes[0]], sums[sizes[0]:]]
    return [g[:-1] / max(1.0, g[-1]) for g in out]


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, aside: np.ndarray, pool: DataFrame | None, rounds: int = ROUNDS) -> Model:
    """``text``, ``meta`` and ``y`` are labelled rows, those ``aside`` kept for the calibration; ``pool`` has the views of all documents."""
    fitted, views = ~aside, (text, meta)
    betas = [logistic(x[fitted], y[fitted], np.ones(int(fitted.sum()))) for x in views]
    for _ in range(rounds if pool is not None else 0):
        givers = list(betas)
        for _ in range(STEPS):
            both = pulls(pool, givers, betas)
            betas = [step(views[v][fitted], y[fitted], betas[v], SHARE * fitted.sum() * both[v]) for v in (0, 1)]
    check, one = aside, np.ones(int(aside.sum()))
    if len(set(y[check])) < 2:
        check, one = fitted, np.ones(int(fitted.sum()))
    logits = [logit(views[v][check], betas[v])[:, None].astype(np.float64) for v in (0, 1)]
    scales = [logistic(z, y[check], one, ridge=0.1) for z in logits]
    both = np.hstack([logit(z, s)[:, None] for z, s in zip(logits, scales, strict=True)])
    return Model(betas[0], betas[1], scales[0], scales[1], logistic(both, y[check], one, ridge=0.1))


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


@given_back
def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, meta = [], []
        for _, _, t, m in features(batch):
            text += [r.tobytes() for r in t.astype(np.float16)]
            meta += [r.tobytes() for r in m.astype(np.float16)]
        yield pa.RecordBatch.from_arrays([batch["draw"], batch["label"], pa.array(text, pa.binary()), pa.array(meta, pa.binary())],
                                         names=["draw", "label", "text", "meta"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """The model, or None where the sampled labels do not hold both classes.

    Labelled rows are drawn by a hash of the id; a document labelled several times counts with
    the majority.  All documents are the pool; true labels are no part of it.
    """
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    one = (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("label")))
    n_labels = one.count()
    chosen = one.where(draw < fit_rows / max(1, n_labels))  # about fit_rows rows at most
    columns = ("label", "text", "source", "lang", "n_chars")
    rows = docs.join(F.broadcast(chosen), "doc_id").select(draw.alias("draw"), *columns)
    sample = rows.mapInArrow(_views, "draw double, label int, text binary, meta binary").orderBy("draw", "text").toPandas()
    y = sample["label"].to_numpy(np.int64)
    aside = (sample["draw"].to_numpy(np.float64) * 1e6).astype(np.int64) % 5 == 0
    if len(set(y[~aside])) < 2:
        return None
    text, meta = (np.stack([np.frombuffer(v, np.float16) for v in sample[c]]).astype(np.float32) for c in ("text", "meta"))
    every = docs.select(F.lit(None).cast("double").alias("draw"), F.lit(None).cast("int").alias("label"), *columns[1:])
    pool = saved(every.mapInArrow(_views, "draw double, label int, text binary, meta binary").select("text", "meta"))
    return cotrain(text, meta, y, aside, pool)


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, quality_score, text_score, meta_score, kept and the columns ``keep`` of every row of ``docs``.

    ``docs`` has doc_id, text, source, lang, n_chars, any of them null; ``labels`` doc_id and
    quality.  A null text counts as empty, null metadata as a value of its own.  Where labels do
    not hold both classes, every score is 0.5 and every row is kept.  Repeated rows give a row
    each, an empty table none.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       F.col("n_chars").cast("long").alias("n_chars"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    model = fit(base, labels)
    give_back()  # the driver's sample
    parts = None if model is None else (model.text, model.meta, model.text_scale, model.meta_scale, model.blend)
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # fixed size

    @given_back
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if shared.value is None else Model(*shared.value)
        for batch in batches:
            out = np.full((batch.num_rows, 3), 0.5)
            if model is not None:
                for at, to, text, meta in features(batch):
                    out[at:to] = model.score(text, meta)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c) for c in out.T.copy()), pa.array(out[:, 0] >= KEEP), *(batch[f"keep_{c}"] for c in keep)],
                names=["doc_id", "quality_score", "text_score", "meta_score", "kept", *(f"keep_{c}" for c in keep)])

    kept = "".join(f", keep_{c} {base.schema[f'keep_{c}'].dataType.simpleString()}" for c in keep)
    out = base.mapInArrow(scored, f"doc_id long, quality_score double, text_score double, meta_score double, kept boolean{kept}")
    return out.select("doc_id", "quality_score", "text_score", "meta_score", "kept", *[F.col(f"keep_{c}").alias(f"kept_{c}") for c in keep])
