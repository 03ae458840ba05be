"""Document fingerprints from prefix polynomial hashes.

For each text two modular prefix arrays are kept, so the hash of any span is one difference: spans
are compared in constant time and the longest common extension of two positions is found by
binary search.  A fingerprint holds the text's length and whole hash, and the smallest hashes of
all its windows, whose overlap with another fingerprint's estimates how alike the texts are.

An edited text, which keeps a prefix and takes the rest from a second text, needs no arrays of its
own: its windows are those of the kept prefix, those of the second text's prefix, and the few
that straddle the seam.

Neighbours in the order of ids meet without a global sort: ids are cut into ranges by quantiles,
a range is sorted in one task, and the first text of each range is also sent to the range before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.words import mix

#: Fixed for all fingerprints to be compared: moduli, bases, code points in a window, hashes kept.
MODULI, BASES = (2147483647, 2147483629), (1103515245, 362436069)
WINDOW, KEPT = 12, 40
#: Ranges of ids for each shuffle partition.
RANGES = 4
_tables: list[list[np.ndarray]] = []


def _powers(n: int) -> list[list[np.ndarray]]:
    """For each modulus the powers 0..n of its base and of the base's inverse."""
    if not _tables or len(_tables[0][0]) <= n:
        size = 1 << max(17, n.bit_length())
        _tables[:] = []
        for p, r in zip(MODULI, BASES, strict=True):
            pair = []
            for base in (r, pow(r, -1, p)):
                out = np.ones(1, np.int64)
                while len(out) < size:  # doubling: the next half is this one times a power
                    out = np.concatenate([out, out * pow(base, len(out), p) % p])
                pair.append(out)
            _tables.append(pair)
    return _tables


class Prefixes:
    """Prefix hash arrays of one text."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        self.n = len(codes)
        self.sums = []
        for p, (up, _) in zip(MODULI, _powers(self.n), strict=True):
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(codes * up[:self.n] % p, out=sums[1:])
            self.sums.append(sums % p)

    def span(self, at, to) -> np.ndarray:
        """Hash of the spans from ``at`` to ``to`` (numbers or arrays); equal spans have equal ones."""
        out = []
        for p, sums, (_, down) in zip(MODULI, self.sums, _powers(self.n), strict=True):
            out.append((sums[to] - sums[at]) % p * down[at] % p)
        return (out[0] << 31) | out[1]

    def windows(self) -> np.ndarray:
        """Mixed hashes of all windows in order; a shorter text is one window, an empty one none."""
        if self.n < WINDOW:
            return mix(np.array([self.span(0, self.n)]).astype(np.uint64)) if self.n else np.empty(0, np.uint64)
        at = np.arange(self.n - WINDOW + 1)
        return mix(self.span(at, at + WINDOW).astype(np.uint64))

    def whole(self) -> int:
        return int(self.span(0, self.n))


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How many code points from a[i:] and b[j:] on are equal, by binary search on span hashes."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def smallest(*parts: np.ndarray) -> np.ndarray:
    """The KEPT smallest distinct hashes of all parts, sorted."""
    x = np.unique(np.concatenate([_least(p) for p in parts]))
    return x[:KEPT]


def _least(x: np.ndarray) -> np.ndarray:
    k = KEPT
    while k < len(x):  # copies of one hash may crowd out others
        some = np.unique(np.partition(x, k)[:k])
        if len(some) >= KEPT:
            return some
        k *= 4
    return np.unique(x)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of both that both hold: an estimate of the windows' Jaccard similarity."""
    both = np.union1d(a, b)[:KEPT]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True)).mean())


def written(n: int, whole: int, least: np.ndarray) -> str:
    return f"{n:x}.{whole:016x}." + "".join(f"{int(h) >> 32:08x}" for h in least)


def edited(a: Prefixes, a_windows: np.ndarray, b: Prefixes, b_windows: np.ndarray) -> tuple[str, int, np.ndarray]:
    """Edited text of ``a`` before ``b``, its whole hash and its smallest window hashes."""
    take = a.n // 3
    kept, taken = a.n - take, min(take, b.n)
    text = a.text[:kept] + b.text[:taken]
    seam_from = max(0, kept - WINDOW + 1)
    seam = Prefixes(text[seam_from:kept + min(WINDOW - 1, taken)])
    whole = []
    for p, x, y, (up, _) in zip(MODULI, a.sums, b.sums, _powers(a.n), strict=True):
        whole.append(int((x[kept] + y[taken] * up[kept]) % p))
    if len(text) < WINDOW:
        parts = [Prefixes(text).windows()]
    else:
        parts = [a_windows[:max(0, kept - WINDOW + 1)] if a.n >= WINDOW else a_windows[:0],
                 b_windows[:max(0, taken - WINDOW + 1)] if b.n >= WINDOW else b_windows[:0],
                 seam.windows() if seam.n >= WINDOW else a_windows[:0]]
    return text, (whole[0] << 31) | whole[1], smallest(*parts)


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double, common_prefix_next long")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, the borrowed one last; each row is done when the next one is there."""
    held = None
    for batch in batches:
        out = []
        for doc, text, bucket, borrowed in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "bucket", "borrowed")), strict=True):
            if borrowed and not (held and held[0] == bucket and held[1]):
                continue  # a repeat of the borrowed row
            prefixes = Prefixes(text)
            windows = prefixes.windows()
            least = smallest(windows)
            if held and held[0] == bucket and held[1]:
                _, _, before, a, a_windows, a_least = held
                new, whole, new_least = edited(a, a_windows, prefixes, windows)
                out.append((before, a.n, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(a.n, a.whole(), a_least),
                            written(len(new), whole, new_least), likeness(a_least, new_least), likeness(a_least, least),
                            common_extension(a, 0, prefixes, 0)))
            held = (bucket, not borrowed, doc, prefixes, windows, least)
        columns = zip(*out, strict=True) if out else [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=[c.split()[0] for c in _OUT.split(", ")])


def _bucket(splitters: list[int]) -> Column:
    """How many of the sorted splitters are at most ``d``."""
    if not splitters:
        return F.lit(0)
    constant = F.split(F.lit(",".join(map(str, splitters))), ",").cast("array<bigint>")
    bits = F.array(*[F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))])
    return F.aggregate(bits, F.lit(0), lambda at, bit: F.when(
        (at + bit <= len(splitters)) & (F.get(constant, at + bit - 1) <= F.col("d")), at + bit).otherwise(at))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its text edited with the next document's.

    The next document is the one with the next smaller doc_id, after the last the first; a null
    doc_id comes last, and rows with the same id follow each other by the hash of their text.
    A null text is an empty one.  Two empty texts are alike (1.0), an empty and another one are
    not (0.0).  A single row is its own next; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = width * RANGES
    quantiles = docs.select(F.col("doc_id").cast("long").alias("d")).approxQuantile("d", [i / count for i in range(1, count)], 0.25 / count)
    bucketed = rows.withColumn("bucket", _bucket(sorted({int(q) for q in quantiles})))
    # the first row of each range, one per range, also goes to the end of the range before
    heads = sorted((r["bucket"], r["h"]["d"], r["h"]["th"]) for r in bucketed.groupBy("bucket").agg(
        F.max(F.struct("d", "th")).alias("h")).collect())
    lent = [(d, th, heads[(i + 1) % len(heads)][0]) for i, (_, d, th) in enumerate(heads)]
    lent = docs.sparkSession.createDataFrame(lent, "d long, th long, to_bucket int")
    borrowed = rows.join(F.broadcast(lent), ["d", "th"]).select(
        "doc_id", "text", "th", "d", F.col("to_bucket").alias("bucket"), F.lit(True).alias("borrowed"))
    return (bucketed.withColumn("borrowed", F.lit(False)).unionByName(borrowed).repartition(width, "bucket")
            .sortWithinPartitions("bucket", "borrowed", F.desc("d"), F.desc("th"))
            .select("doc_id", "text", "bucket", "borrowed").mapInArrow(_fingerprints, _OUT))
