"""Best-fit packing by minimum bin slack.

Bins are filled one after the other.  Each starts with the longest piece left; a subset-sum
dynamic program over the lengths still available, kept as a bitset of reachable sums, finds the
fullest combination that fits beside it, and the combination is removed.

The plan needs nothing but the number of pieces of each length, a table of at most ``capacity``
rows whatever the corpus, so it is made once on the driver, with each combination used as often
as its lengths last.  Which piece goes where is then a join: pieces of a length are numbered by
Spark without gathering a length in one task, and the number falls in exactly one plan entry.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.memory import given_back
from strandloom.llm.tokens import WordEncoder, default_path
from strandloom.session import saved

CAPACITY = 4096
END_ID = 1
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: each document's ids and an end id, cut only where longer than ``capacity``."""
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()

    @given_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True) if rows else [[]] * 5,
                (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def fullest(counts: dict[int, int], space: int) -> list[tuple[int, int]]:
    """(length, how many) of the available lengths with the largest sum up to ``space``."""
    mask, reach, steps = (1 << (space + 1)) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= space), reverse=True):
        left, take = min(counts[length], space // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> space & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return list(chosen.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Entries (length, first number, bins, how many a bin, first sequence, offset in the sequence)."""
    counts, used, out, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    for seed in sorted(counts, reverse=True):
        while counts[seed]:
            counts[seed] -= 1
            bin_ = dict([(seed, 1)])
            for length, k in fullest(counts, capacity - seed):
                bin_[length] = bin_.get(length, 0) + k
            counts[seed] += 1
            bins = min(counts[n] // k for n, k in bin_.items())
            offset = 0
            for length, k in bin_.items():
                out.append((length, used[length], bins, k, sequence, offset))
                used[length] += bins * k
                counts[length] -= bins * k
                offset += length * k
            sequence += bins
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (a saved table with ``length`` and the keys doc_id, piece) with sequence_id and offset."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, sum(counts.values()))
    # numbering groups: a length's rows are spread by a hash so that no group holds much more
    # than a quarter of a task's even share, then the groups' counts are chained
    groups = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = spark.createDataFrame([(n, -(-c * groups // total)) for n, c in counts.items()], "length long, salts long")
    salted = parts.join(F.broadcast(spread), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    before = (Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    chained = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    numbered = (salted.withColumn("k", F.row_number().over(within) - 1).join(chained, ["length", "salt"])
                .withColumn("number", F.col("first") + F.col("k")))
    # at most capacity entries for each of the few lengths of a bin
    entries = spark.createDataFrame(plan(counts, capacity),
                                    "e_length long, e_first long, bins long, each long, e_sequence long, e_offset long")
    at = F.col("number") - F.col("e_first")
    return (numbered.join(F.broadcast(entries), (F.col("length") == F.col("e_length")) & (at >= 0)
                          & (at < F.col("bins") * F.col("each")))
            .select(*parts.columns, (F.col("e_sequence") + F.floor(at / F.col("each"))).alias("sequence_id"),
                    (F.col("e_offset") + at % F.col("each") * F.col("length")).alias("offset")))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Packs documents (doc_id, text; other columns are ignored) into sequences of ``capacity`` tokens.

    A null or empty text is its end id alone.  Repeated rows and null ids are packed like any
    other row.  An empty table gives no rows.
    """
    return pack(saved(pieces(docs, capacity, end_id, path)), capacity)
