"""Similarity join of word-shingle sets by Jaccard, size-aware with light and heavy sets.

A set of n shingles that is similar to another shares at least ceil(t * n) of them, so in any
order common to all sets two similar sets share l of their first n - ceil(t * n) + l shingles.
The order puts shingles that many documents hold last (counted over all documents in a table of
fixed size), then goes by hash.

* Light sets, below a size boundary, enumerate all 2-subsets of that prefix (l = 2); similar
  light sets share a subset.
* Heavy sets are entered in inverted lists under each shingle of the prefix (l = 1), as are the
  light sets that are large enough to resemble one; the lists are scanned and shared shingles
  counted.  Where in both sets the shared shingles must lie, and how many, drops other pairs.
* The boundary is where the summed cost of both, taken over all documents, is lowest.

Sets that are equal are one node.  Lists of copies would give pairs by the square, so they are
scanned twice: first each member of a list is compared with the list's first member alone, which
ties groups of copies together, then with a most central one; then pairs are drawn from a list only where its members are still in different components.  Every candidate is checked on the whole sets of its texts, and
no pair that could join two components is left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.memory import given_back
from strandloom.llm.words import BLOCK, block_words, mix, text_blocks
from strandloom.operators.components import connected_components
from strandloom.session import saved

SHINGLE, PERCENT = 5, 75
#: The frequency table has 2**BITS counters; a shingle counts as frequent from about HOT documents on.
BITS, HOT = 24, 12
#: Light sets are smaller than this at most.
LIGHT_MOST = 256
#: Members compared with one pivot in one group of the check.
SALT_ROWS = 400
#: Filter of fixed size in front of the texts: 2**SLOT_BITS words of 64 bits.
SLOT_BITS = 16
_STEPS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def least_overlap(n):
    """ceil(t * n): what a set of n shingles shares with a similar one at least."""
    return -(-PERCENT * n // 100)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingle hashes) for a text column."""
    for at, to, raw, offsets in text_blocks(column):
        words, first = block_words(raw, offsets)
        span = max(0, len(words) - SHINGLE + 1)
        total = np.zeros(span, np.uint64)
        for k in range(SHINGLE):
            total += words[k:k + span] * _STEPS[k]
        shingles = mix(total)
        for row in range(to - at):
            a, b = int(first[row]), int(first[row + 1])
            if b - a >= SHINGLE:
                yield at + row, np.unique(shingles[a:b - SHINGLE + 1])
            elif b > a:  # the whole sequence as one
                yield at + row, mix((words[a:b] * _STEPS[:b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield at + row, np.empty(0, np.uint64)


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """For each counter, 0 or the bits of the number of documents with frequent shingles there.

    Each task reports the counters that stand out in its own rows; they are summed over all.
    """
    @given_back
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, carried, total = np.zeros(1 << BITS, np.uint16), Counter(), 0

        def add(hashes: list[np.ndarray]) -> None:
            at, n = np.unique(np.concatenate(hashes) >> np.uint64(64 - BITS), return_counts=True)
            at = at.astype(np.int64)
            now = counts[at].astype(np.int64) + n
            for k in np.flatnonzero(now >= 1 << 16):  # the part that 16 bits cannot hold
                carried[int(at[k])] += int(now[k])
                now[k] = 0
            counts[at] = now

        for batch in batches:
            waiting, size = [], 0
            for _, own in shingle_sets(batch["text"]):
                waiting.append(own)
                size += len(own)
                total += len(own)
                if size >= BLOCK:
                    add(waiting)
                    waiting, size = [], 0
            if waiting:
                add(waiting)
        mean = total / (1 << BITS)
        out = np.union1d(np.flatnonzero(counts >= max(3, mean + 4 * np.sqrt(mean))), np.array(sorted(carried), np.int64))
        n = counts[out].astype(np.int64) + np.array([carried[int(k)] for k in out], np.int64) - int(mean)
        yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(n)], names=["counter", "n"])

    found = (docs.select("text").mapInArrow(partial, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= HOT).toPandas())  # 2**BITS rows at most
    levels = np.zeros(1 << BITS, np.uint8)
    levels[found["counter"].to_numpy(np.int64)] = np.log2(found["n"].to_numpy(np.float64)).astype(np.uint8) + 1
    return levels


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, set size n, the set's digest c1 and c2, its prefix and what scanning the prefix's lists costs.

    Only the first document of a set in each task carries the prefix.
    """
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs))  # fixed size

    @given_back
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            size, c1, c2, cost, ends, prefixes = [], [], [], [], [0], []
            for _, own in shingle_sets(batch["text"]):
                n = len(own)
                a, b = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8").tolist() if n else (None, None)
                prefix, scan = own[:0], 0
                if n >= 3 and a not in seen:
                    seen.add(a)
                    level = levels.value[(own >> np.uint64(64 - BITS)).astype(np.int64)]
                    order = np.argsort(level, kind="stable") if level.any() else np.arange(n)
                    order = order[:n - least_overlap(n) + 2]
                    prefix, level = own[order], level[order][:-1].astype(np.int64)
                    scan = int((1 + level).sum())  # an entry meets few others of its list, more in longer ones
                size.append(n)
                c1.append(a)
                c2.append(b)
                cost.append(scan)
                ends.append(ends[-1] + len(prefix))
                prefixes.append(prefix)
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["th"], pa.array(size, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                 pa.array(cost, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "th", "n", "c1", "c2", "cost", "prefix"])

    return docs.mapInArrow(describe, "doc_id long, th long, n long, c1 long, c2 long, cost long, prefix array<long>")


def boundary(sets: DataFrame) -> int:
    """The size below which sets are light: lowest total of subsets enumerated and lists scanned."""
    rows = (sets.where((F.size("prefix") > 0) & (F.col("n") < LIGHT_MOST)).groupBy("n")
            .agg(F.count(F.lit(1)).alias("sets"), F.sum("cost").alias("scan")).orderBy("n").collect())
    best, at, total = 0, 3, 0
    for r in rows:
        p = r["n"] - least_overlap(r["n"]) + 2
        total += r["sets"] * p * (p - 1) // 2 - r["scan"]
        if total < best:
            best, at = total, r["n"] + 1
    return at


def _where(listed: bool) -> Column:
    """One long for the kind of a key, the set's size and the last position in its order that the key uses."""
    return F.lit(int(listed) << 62) + F.shiftleft(F.col("n"), 31) + F.col("pos")


def _size(where: Column) -> Column:
    return F.shiftright(where, 31).bitwiseAND(2**31 - 1)


def _entries(sets: DataFrame, light: int) -> DataFrame:
    """key, node, where: subsets of light sets and list entries of heavy ones (and of light ones near the boundary)."""
    subsets = F.expr("flatten(transform(prefix, (t, i) -> transform(slice(prefix, i + 2, greatest(size(prefix) - i - 1, 0)), "
                     "(u, j) -> struct(xxhash64(t, u, 2) AS key, i + j + 1 AS pos))))")
    some = sets.where(F.size("prefix") > 0)
    small = some.where(F.col("n") < light).select("c1", "n", F.inline(subsets))
    large = some.where(F.col("n") * 100 >= light * PERCENT).select(
        "c1", "n", F.posexplode(F.expr("slice(prefix, 1, size(prefix) - 1)")).alias("pos", "key"))
    return small.select("key", F.col("c1").alias("node"), _where(False).alias("where")).unionByName(
        large.select("key", F.col("c1").alias("node"), _where(True).alias("where")))


def _pairs(met: DataFrame, light: int) -> DataFrame:
    """The pairs (a, b) that can be similar, from rows a, a_where, b, b_where for each key they meet in.

    Sets of x and y shingles are similar with ``o`` common ones, the least l of which lie among
    their first x - o + l and y - o + l; other meetings prove nothing.  A pair needs l meetings
    in lists, or one in subsets, where l is 2.
    """
    return (met.where(_counts(light)).groupBy("a", "b", _least().alias("l"), (F.col("a_where") >= 1 << 62).alias("listed"))
            .agg(F.count(F.lit(1)).alias("k")).where("k >= l or not listed").select("a", "b").distinct())


def _overlap() -> tuple[Column, Column, Column]:
    x, y = _size(F.col("a_where")), _size(F.col("b_where"))
    return x, y, F.floor((PERCENT * (x + y) + 99 + PERCENT) / F.lit(100 + PERCENT))


def _least() -> Column:
    x, y, o = _overlap()
    stored = o - F.floor((PERCENT * F.greatest(x, y) + 99) / F.lit(100)) + 1  # prefixes go no further
    return F.when(F.col("a_where") >= 1 << 62, F.least(F.greatest(F.floor((x + y) / F.lit(56)), F.lit(1)), stored)).otherwise(2)


def _counts(light: int) -> Column:
    """Whether a meeting of sets of similar size and of the same kind of key counts."""
    x, y, o = _overlap()
    a, b = F.col("a_where"), F.col("b_where")
    pos = lambda w: w.bitwiseAND(2**31 - 1)
    return (((a >= 1 << 62) == (b >= 1 << 62)) & (100 * F.least(x, y) >= PERCENT * F.greatest(x, y))
            & ((a < 1 << 62) | (F.greatest(x, y) >= light)) & (pos(a) < x - o + _least()) & (pos(b) < y - o + _least()))


@given_back
def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, pivot first): keeps members whose set is similar to their pivot's."""
    pivot, key = None, None
    for batch in batches:
        a, b, salt = batch["a"].to_pylist(), batch["b"].to_pylist(), batch["salt"].to_pylist()
        out = []
        for row, own in shingle_sets(batch["text"]):
            if b[row] is None:
                pivot, key = own, (a[row], salt[row])
            elif key == (a[row], salt[row]):
                common = len(np.intersect1d(pivot, own, assume_unique=True))
                if 100 * common >= PERCENT * (len(pivot) + len(own) - common):
                    out.append((a[row], b[row]))
        x, y = zip(*out, strict=True) if out else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar; ``texts`` has node, text."""
    pairs = saved(pairs)
    texts = _near(texts, "node", pairs.select(F.explode(F.array("a", "b")).alias("node")))
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    salted = pairs.join(counted, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / SALT_ROWS)).cast("long"))
    members = salted.select("a", "salt", "b").join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    pivots = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select(
        "a", "salt", F.lit(None).cast("long").alias("b"), "text")
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (members.unionByName(pivots).repartition(width, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
            .mapInArrow(_check, "a long, b long"))


def _near(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose hash in ``column`` is in ``wanted``, and some others: a filter of fixed size, without a shuffle of rows."""
    slot = F.shiftrightunsigned(column, 6).bitwiseAND((1 << SLOT_BITS) - 1)
    slots = wanted.groupBy(slot.alias("slot")).agg(F.expr(f"bit_or(shiftleft(1L, cast({column} & 63 as int)))").alias("bits"))
    return (rows.withColumn("slot", slot).join(F.broadcast(slots), "slot")  # 2**SLOT_BITS rows at most
            .where(f"shiftrightunsigned(bits, cast({column} & 63 as int)) & 1 = 1").drop("slot", "bits"))


def _texts(docs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, text for the given nodes."""
    wanted = saved(sets.where(F.size("prefix") > 0).join(nodes, F.col("c1") == F.col("node"), "left_semi")
                   .groupBy(F.col("c1").alias("node")).agg(F.min("th").alias("th")))
    return saved(_near(docs.select("th", "text"), "th", wanted).dropDuplicates(["th"]).join(wanted, "th").select("node", "text"))


def _apart(shared: DataFrame, state: DataFrame) -> DataFrame:
    """The entries of lists whose members are in more than one component, with the state (component, central) of each."""
    of_key = Window.partitionBy("key")
    placed = shared.select("key", "node", "where").join(state, "node")
    return (placed.withColumn("low", F.min("component").over(of_key)).withColumn("high", F.max("component").over(of_key))
            .where("low <> high").drop("low", "high"))


def join_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text hash and component node for every row of ``docs`` (doc_id, text).

    A null text and one without words have an empty set, linked with nothing: component_id is
    their own doc_id and component is null.  Equal texts under repeated ids are linked like any
    others; a null doc_id takes part, and is the component only where no other id is.  An empty
    table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64(F.col("text").cast("string")).alias("th"))
    sets = saved(described(docs))
    light = boundary(sets)
    of_key = Window.partitionBy("key")
    entries = (_entries(sets, light).withColumn("low", F.min("node").over(of_key)).withColumn("high", F.max("node").over(of_key))
               .where("low <> high").dropDuplicates(["key", "node"]))
    # sets of a list whose sizes are alike meet their first one
    band = F.floor(F.log(_size(F.col("where")).cast("double")) / F.log(F.lit(100 / PERCENT)))
    alike = Window.partitionBy("key", "band")
    shared = saved(entries.withColumn("band", band).withColumn("first", F.min(F.struct("node", "where")).over(alike))
                   .select("key", "node", "where", F.col("first.node").alias("a"), F.col("first.where").alias("a_where")))
    firsts = _pairs(shared.where("a <> node").select("a", "a_where", F.col("node").alias("b"), F.col("where").alias("b_where")), light)
    texts = _texts(docs, shared.select("node").distinct(), sets)
    links = saved(similar(firsts, texts))
    known = saved(connected_components(links))
    # central sets share most of what they entered; they tie the rest of a group of near copies together
    central = saved(shared.groupBy("node").agg((F.count(F.lit(1)) / F.max(_size(F.col("where")))).alias("central")))

    def state():
        return central.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))

    apart = saved(_apart(shared, state()))
    stars = (apart.withColumn("first", F.max(F.struct("central", "node", "where", "component")).over(of_key))
             .where("first.component <> component").select(F.col("first.node").alias("a"), F.col("first.where").alias("a_where"),
                                                           F.col("node").alias("b"), F.col("where").alias("b_where")))
    found = saved(similar(_pairs(stars, light), texts))
    if not found.isEmpty():
        links = links.unionByName(found)
        known = saved(connected_components(links))
        apart = saved(_apart(apart, state()))
    # what is still apart gives its pairs across components
    x, y = (apart.select("key", F.col("node").alias(n), F.col("where").alias(f"{n}_where"), F.col("component").alias(f"{n}_in")) for n in "ab")
    across = x.join(y, (x["key"] == y["key"]) & (F.col("a_in") != F.col("b_in")) & (F.col("a") < F.col("b")) & _counts(light))
    found = saved(similar(_pairs(across.select("a", "a_where", "b", "b_where"), light), texts))
    nodes = known if found.isEmpty() else saved(connected_components(links.unionByName(found)))
    # smallest id of each component, then back to the documents
    smallest = sets.where("c1 is not null").groupBy(F.col("c1").alias("node")).agg(F.min("doc_id").alias("first"))
    smallest = smallest.join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = smallest.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = smallest.join(lowest, "component").select("node", "component_id", "component")
    return (sets.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("c1").alias("node"))
            .join(of_node, "node", "left")
            .select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    "th", "component"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the one with the smallest doc_id.

    Documents with an empty set are linked with nothing and stay.  Only rows whose text hash may
    belong to a group of several rows are shuffled; all others stay where they are.
    """
    rows = saved(join_sets(docs).where("component is not null").select("doc_id", "th", "component"))
    groups = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th")).alias("first")).where("n > 1")
    keepers = saved(groups.select("component", F.col("first.doc_id").alias("keep_id"), F.col("first.th").alias("keep_th")))
    slot = F.shiftrightunsigned("th", 6).bitwiseAND((1 << SLOT_BITS) - 1)
    slots = (rows.join(keepers, "component", "left_semi").groupBy(slot.alias("slot"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(th & 63 as int)))").alias("bits")))
    th = F.xxhash64(F.col("text").cast("string"))
    marked = (docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), th.alias("th"))
              .withColumn("slot", slot).join(F.broadcast(slots), "slot", "left")  # 2**SLOT_BITS rows at most
              .withColumn("shared", F.expr("coalesce(shiftrightunsigned(bits, cast(th & 63 as int)) & 1, 0) = 1")))
    # of the rows that may be in a group: those in none, and the first of each
    grouped = rows.join(keepers, "component").groupBy("doc_id", "th").agg(
        F.max(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))).alias("keep"))
    doubtful = marked.where("shared").select("row", "id", "th").join(
        grouped.withColumnRenamed("th", "th_"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("th_")), "left")
    single = doubtful.where("keep is null").select("row")
    first = doubtful.where("keep").dropDuplicates(["id", "th"]).select("row")
    return marked.where("not shared").select("row.*").unionByName(single.select("row.*")).unionByName(first.select("row.*"))
