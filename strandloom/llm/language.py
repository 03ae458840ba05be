"""Language identification by the nearest of several clustered centroids per language.

A text becomes a unit vector of log term frequency times inverse document frequency over hashed
byte n-grams of its letters.  Document frequencies are counted over all training rows.  Centroids
are fitted by spherical k-means, a few per language, on a bounded sample of labelled rows.  A
text gets the language of the centroid with the highest cosine.  It is rejected by a logistic
model of that cosine, its margin to the next language and the text's length, calibrated on rows
left out of the centroids: as they are, with their own language left out, and with shuffled letters.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.memory import give_back, given_back
from strandloom.llm.words import mix, text_blocks

#: Buckets of hashed n-grams, and their sizes in bytes.
DIM, SIZES = 4096, (1, 2, 3)
#: Centroids per language, and the bound on labelled rows that they are fitted on (all languages together).
CENTROIDS, FIT_ROWS = 4, 4000
#: Calibrated rows of a learned language that may be rejected, and others that may be kept where both can be had.
LOST, PASSED = 0.001, 0.01
UNKNOWN = "und"
_ROWS = 256
_PLAIN = np.arange(256, dtype=np.uint8)  # ASCII other than a-z counts as a gap
_PLAIN[:97] = _PLAIN[123:128] = 32


def counts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, n-gram counts of these rows) for a text column."""
    for begin in range(0, len(column), _ROWS):
        rows = pc.utf8_lower(column.slice(begin, _ROWS).cast(pa.large_string()).fill_null(""))
        for at, to, raw, offsets in text_blocks(rows):
            # one gap before each text, and runs of gaps made one
            low = np.full(len(raw) + to - at, 32, np.uint8)
            doc = np.repeat(np.arange(to - at), np.diff(offsets))
            low[np.arange(len(raw)) + doc + 1] = _PLAIN[raw]
            owner = np.repeat(np.arange(to - at), np.diff(offsets) + 1)
            keep = low != 32
            keep[1:] |= low[:-1] != 32
            keep[np.flatnonzero(np.diff(owner)) + 1] = True
            low, owner = low[keep].astype(np.uint64), owner[keep]
            out = np.zeros((to - at, DIM), np.float32)
            gram = np.zeros(len(low), np.uint64)
            for size in range(1, max(SIZES) + 1):
                if len(low) < size:
                    break
                gram = (gram[:len(low) - size + 1] << np.uint64(8)) | low[size - 1:]
                if size in SIZES:
                    same = owner[:len(gram)] == owner[size - 1:]
                    whole = gram[same] if size > 1 else gram[same & (gram != 32)]
                    at_doc = owner[:len(gram)][same if size > 1 else same & (gram != 32)]
                    bucket = (mix(whole + (np.uint64(size) << np.uint64(56))) % np.uint64(DIM)).astype(np.int64)
                    out += np.bincount(at_doc * DIM + bucket, minlength=out.size).reshape(out.shape)
            yield begin + at, begin + to, out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    weights: np.ndarray  # of the features of a text
    cut: float  # their sum below which a text is rejected
    longest: float  # log length of calibrated rows

    def judged(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, cosine and whether it is rejected, of each row."""
        cosine = vectors(counts, self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        names = np.array(self.languages)
        by_language = np.stack([cosine[:, names == lang].max(axis=1) for lang in dict.fromkeys(self.languages)], axis=1)
        x = features(by_language, np.minimum(np.log1p(counts.sum(axis=1)), self.longest))
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1), x @ self.weights < self.cut


def features(by_language: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of rows with a cosine for each language and a log length."""
    ordered = np.sort(by_language, axis=1)
    top, next_ = ordered[:, -1], np.maximum(ordered[:, -2], 0) if ordered.shape[1] > 1 else 0
    margin = top - next_
    return np.stack([np.ones(len(top)), top, margin, length, top * length, margin * length, length * length], axis=1)


def calibrated(own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights that tell features of learned languages from others, and the cut."""
    x, y = np.concatenate([own, others]), np.repeat([1.0, 0.0], [len(own), len(others)])
    balance = np.where(y > 0, 0.5 / max(1, len(own)), 0.5 / max(1, len(others))) * len(x)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (balance * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (balance * (y - p)) - 1e-2 * w)
        w += step / max(1.0, np.abs(step).max() / 5)
    low = np.quantile(x[y > 0] @ w, LOST)
    high = np.quantile(x[y == 0] @ w, 1 - PASSED) if len(others) else low
    return w, float(low if high >= low else (low + high) / 2)


def training(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.where(~held_out & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))


def _frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows, and in how many of them each bucket occurs."""
    @given_back
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, np.int64), np.arange(DIM + 1)
        for batch in batches:
            df[DIM] += batch.num_rows
            for _, _, counts in counts_of(batch["text"]):
                df[:DIM] += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(df)], names=["bucket", "df"])

    total = rows.select("text").mapInArrow(partial, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(DIM + 1, np.int64)
    df[total["bucket"].to_numpy(np.int64)] = total["df"].to_numpy(np.int64)
    return int(df[DIM]), df[:DIM]


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means, started from points far from each other."""
    first = x.mean(axis=0)
    chosen = [int(np.argmax(x @ first))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centers = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def shuffled(text: str | None) -> str | None:
    """The text with its letters in another order, which its own bytes decide."""
    if text is None:
        return None
    letters = [c for c in text if not c.isspace()]
    random.Random(zlib.crc32(text.encode("utf-8", "replace"))).shuffle(letters)
    rest = iter(letters)
    return "".join(c if c.isspace() else next(rest) for c in text)


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, k: int = CENTROIDS) -> Model | None:
    """The model of ``rows`` (doc_id, text, lang), or None without any."""
    per_language = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_language:
        return None
    n, df = _frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    share = fit_rows / len(per_language)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chance = F.create_map(*[F.lit(v) for lang, c in per_language.items() for v in (lang, min(1.0, share / c))])

    @given_back
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for column in (batch["text"], pa.array(map(shuffled, batch["text"].to_pylist()), pa.string())):
                packed = []
                for _, _, counts in counts_of(column):
                    for row in counts:
                        at = np.flatnonzero(row)
                        packed.append(at.astype(np.uint16).tobytes() + row[at].astype(np.float32).tobytes())
                both.append(pa.array(packed, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch["lang"], *both], names=["lang", "packed", "shuffled"])

    def unpacked(column) -> np.ndarray:
        x = np.zeros((len(column), DIM), np.float32)
        for i, raw in enumerate(column):
            m = len(raw) // 6
            x[i, np.frombuffer(raw, np.uint16, m)] = np.frombuffer(raw, np.float32, m, 2 * m)
        return x

    sample = (rows.where(draw < chance[F.col("lang")]).mapInArrow(sampled, "lang string, packed binary, shuffled binary")
              .orderBy("lang", "packed").toPandas())  # about fit_rows rows
    languages, centers, halves, aside = [], [], [], []
    for lang, group in sample.groupby("lang", sort=True):
        counts = unpacked(group["packed"])
        some = np.flatnonzero(counts.sum(axis=1) > 0)
        if len(some):
            x = vectors(counts[some], idf)
            own = clustered(x, k)
            languages += [str(lang)] * len(own)
            centers.append(own)
            # equal rows stay on one side
            half = np.array([zlib.crc32(group["packed"].iloc[i]) % 2 for i in some], bool)
            half = half if 0 < half.sum() < len(half) else np.ones(len(half), bool)
            halves.append(clustered(x[half], k))
            rest = some[~half] if not half.all() else some
            aside.append((group["packed"].iloc[rest], group["shuffled"].iloc[rest]))
    if not languages:
        return None
    own, others, longest = [], [], 0.0
    for lang, both in enumerate(aside):
        for column, real in zip(both, (True, False), strict=True):
            counts = unpacked(column)
            length = np.log1p(counts.sum(axis=1))
            x = vectors(counts, idf)
            by_language = np.stack([(x @ c.T).max(axis=1) for c in halves], axis=1)
            (own if real else others).append(features(by_language, length))
            if real and len(halves) > 1:
                others.append(features(np.delete(by_language, lang, axis=1), length))
            longest = max(longest, float(length.max()))
    return Model(languages, np.concatenate(centers), idf, *calibrated(np.concatenate(own), np.concatenate(others)), longest)


def identify(docs: DataFrame, held_out: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected and the columns ``keep`` of every row of ``docs``.

    The model learns from rows that are not held out and whose lang is not null.  A null text or
    one without letters is ``und`` with score 0 and rejected, as is every text when there is
    nothing to learn from.  Ties go to the first language by name.  Repeated rows give a row
    each, an empty table none.
    """
    model = fit(training(docs, held_out))
    give_back()  # the driver's sample
    parts = None if model is None else tuple(getattr(model, f.name) for f in fields(model))
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # centroids: languages x k x DIM floats
    rows = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.col("doc_id"), held_out.alias("held_out"),
                       F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    @given_back
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if shared.value is None else Model(*shared.value)
        for batch in batches:
            n = batch.num_rows
            score, best, far = np.zeros(n), np.zeros(n, np.int64), np.ones(n, bool)
            if m is not None:
                for at, to, counts in counts_of(batch["text"]):
                    best[at:to], score[at:to], far[at:to] = m.judged(counts)
            known = batch["letters"].to_numpy(zero_copy_only=False) & (m is not None)
            score[~known] = 0
            names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            rejected = ~known | far
            yield pa.RecordBatch.from_arrays(
                [*(batch[f"keep_{c}"] for c in keep), batch["doc_id"], batch["held_out"], pa.array(names, pa.string()),
                 pa.array(score), pa.array(rejected)],
                names=[*(f"keep_{c}" for c in keep), "doc_id", "held_out", "lang_pred", "score", "rejected"])

    kept = ", ".join(f"keep_{c} {rows.schema[f'keep_{c}'].dataType.simpleString()}" for c in keep)
    out = rows.mapInArrow(nearest, f"{kept}{', ' if kept else ''}doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                   "held_out boolean, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected", *[F.col(f"keep_{c}").alias(f"kept_{c}") for c in keep])


def held_out_by(modulus: int, remainder: int) -> Column:
    """Rows held out from learning by the CRC of their id; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder
