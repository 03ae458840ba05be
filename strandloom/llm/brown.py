"""Language-model scores by Brown classes.

Exchange clustering moves units between classes while the likelihood of the class bigrams grows;
units are the most frequent words, and what is left by last character and length.  Then every
other known word is taken out of its shape and exchanged as well: Spark sums how often each word
follows and precedes each class, and the word goes to the class in which that is most likely.

A word's probability is that of its class after the class before it, and of the word in its
class.  Words beyond the known ones share the place of their shape in a class, and have a
probability in the shape; each factor is smoothed and sums to one.

Counts cover all training documents.  The tables that reach the driver have a fixed bound: the
KNOWN most frequent words with a class each, the pair counts of UNITS units, those of classes.  Words beyond
them are counted and looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.memory import give_back, given_back
from strandloom.llm.words import block_spans, span_hashes, text_blocks
from strandloom.session import saved

#: Units: frequent words, then shapes of the others, then the end of a text.  KNOWN bounds the words looked up without a join.
SHAPES, UNITS, KNOWN = 127, 1024, 1 << 18
END = UNITS - 1
UNIT_WORDS = UNITS - SHAPES - 1
CLASSES, ROUNDS = 64, 6
#: How often a word must occur to have a class of its own contexts; rarer ones go by their shape.
EVIDENCE = 8
#: Weight of the class frequencies in a transition, and what is added to each count of a unit.
PRIOR, ADD = 20.0, 0.5
_FLUSH = 2_000_000
_LAST = np.full(256, 30, np.uint8)  # the last byte: letters, digits, other scripts, stops, commas, the rest
_LAST[97:123], _LAST[48:58], _LAST[128:] = np.arange(26), 26, 27
_LAST[ord(".")], _LAST[ord(",")] = 28, 29


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, shapes, rows' offsets in them) of a text column."""
    for at, to, raw, offsets in text_blocks(column):
        low, starts, ends = block_spans(raw, offsets)
        length = np.minimum((ends - starts - 1) // 3, 3)
        yield at, to, span_hashes(low, starts, ends), _LAST[low[ends - 1]] * 4 + length, np.searchsorted(starts, offsets)


def with_ends(values: np.ndarray, first: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The rows' values with ``end`` after each row, and the row of each."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first) + 1)
    out = np.full(len(owner), end, np.asarray(values).dtype)
    out[np.arange(len(values)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = values
    return out, owner


def vocabulary(training: DataFrame) -> DataFrame:
    """word (hash), shape and c, its count, of every word of the training texts."""
    @given_back
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            words, shapes, counts = map(np.concatenate, zip(*held, strict=True))
            unique, first, where = np.unique(words, return_index=True, return_inverse=True)
            return unique, shapes[first], np.bincount(where, counts).astype(np.int64)

        def out(words, shapes, counts):
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(shapes.astype(np.int32)), pa.array(counts)],
                                              names=["word", "shape", "c"])

        for batch in batches:
            for _, _, words, shapes, _ in tokens(batch["text"]):
                held.append((words, shapes, np.ones(len(words), np.int64)))
                if sum(len(h[0]) for h in held) > _FLUSH:
                    held[:] = [merged()]
                    if len(held[0][0]) > _FLUSH // 2:
                        yield out(*held.pop())
        if held:
            yield out(*merged())

    return (training.select("text").mapInArrow(partial, "word long, shape int, c long")
            .groupBy("word", "shape").agg(F.sum("c").alias("c")))


def _at_least(words: DataFrame, most: int) -> int:
    """The lowest count that at most ``most`` words reach."""
    steps = words.groupBy(F.when(F.col("c") < 64, F.col("c")).otherwise(F.floor(F.exp(F.floor(F.log("c") * 16) / 16))).alias("low")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("low")).collect()  # some hundred rows
    total, least = 0, 1
    for at, r in enumerate(steps):
        total += r["n"]
        if total > most:
            return steps[at - 1]["low"] if at else 1 << 62
        least = r["low"]
    return least


@dataclass(frozen=True)
class Lexicon:
    words: np.ndarray  # sorted hashes of the known words
    counts: np.ndarray
    units: np.ndarray  # of each: a unit of its own, or -1
    n: int  # training tokens
    v: int  # distinct ones
    docs: int

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word, and whether it is known."""
        if not len(self.words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return at, self.words[at] == words

    def unit_of(self, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        at, known = self.look_up(words)
        unit = self.units[at] if len(self.units) else np.full(len(words), -1)
        return np.where(known & (unit >= 0), unit, UNIT_WORDS + shapes)


def pair_counts(training: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """How often each unit follows each other one; a text follows an end."""
    shared = training.sparkSession.sparkContext.broadcast(tuple(vars(lexicon).values()))

    @given_back
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lexicon = np.zeros(UNITS * UNITS, np.int64), Lexicon(*shared.value)
        for batch in batches:
            for _, _, words, shapes, first in tokens(batch["text"]):
                unit, _ = with_ends(lexicon.unit_of(words, shapes), first, END)
                code = np.concatenate([[END], unit[:-1]]) * UNITS + unit
                if len(code) > 200_000:
                    counts += np.bincount(code, minlength=UNITS * UNITS)
                else:
                    np.add.at(counts, code, 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["pair", "n"])

    table = training.select("text").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(UNITS * UNITS)
    out[table["pair"].to_numpy(np.int64)] = table["n"].to_numpy(np.float64)
    return out.reshape(UNITS, UNITS)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit.  The end of a text keeps a class of its own, the last."""
    size = pairs.sum(axis=0)
    of = np.zeros(len(pairs), np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[order != len(pairs) - 1]
    of[order] = np.arange(len(order)) % (classes - 1)
    of[-1] = classes - 1
    member = np.eye(classes)[of]
    m = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not size[u]:
                continue
            a, own = of[u], pairs[u, u]
            r = np.bincount(of, pairs[u], minlength=classes)
            l = np.bincount(of, pairs[:, u], minlength=classes)  # noqa: E741
            r[a] -= own
            l[a] -= own
            m[a] -= r
            m[:, a] -= l
            m[a, a] -= own
            rows, columns = m.sum(axis=1) + l, m.sum(axis=0) + r  # wherever u goes
            here, down = _phi(m + r) - _phi(m), _phi(m + l[:, None]) - _phi(m)
            gain = here.sum(axis=1) + down.sum(axis=0)
            d = np.diagonal(m)
            gain += _phi(d + r + l + own) - _phi(d) - np.diagonal(here) - np.diagonal(down)
            gain -= _phi(rows + r.sum() + own) - _phi(rows) + _phi(columns + l.sum() + own) - _phi(columns)
            gain[-1] = -np.inf
            b = int(np.argmax(gain))
            b = b if gain[b] > gain[a] + 1e-9 else a
            m[b] += r
            m[:, b] += l
            m[b, b] += own
            of[u] = b
            moved += b != a
        if not moved:
            break
    return of


def transitions(m: np.ndarray) -> np.ndarray:
    """Smoothed probabilities of classes after each class, from their pair counts."""
    prior = (m.sum(axis=0) + 1) / (m.sum() + CLASSES)
    return (m + PRIOR * prior) / (m.sum(axis=1, keepdims=True) + PRIOR)


def contexts(training: DataFrame, lexicon: Lexicon, of: np.ndarray) -> DataFrame:
    """word (its place in the lexicon), side and n: how often a word without a unit follows (side = a class)
    and precedes (side = CLASSES + a class) each class."""
    shared = training.sparkSession.sparkContext.broadcast((tuple(vars(lexicon).values()), of))

    @given_back
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, of = Lexicon(*shared.value[0]), shared.value[1]
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for _, _, words, shapes, first in tokens(batch["text"]):
                at, found = lexicon.look_up(words)
                sought = found & (lexicon.units[at] < 0) & (lexicon.counts[at] >= EVIDENCE) if len(lexicon.units) else found
                place, _ = with_ends(np.where(sought, at, -1), first, -1)
                unit, _ = with_ends(lexicon.unit_of(words, shapes), first, END)
                cls = of[unit]
                here = np.flatnonzero(place >= 0)
                code = place[here] * (2 * CLASSES)
                before = np.where(here > 0, cls[here - 1], CLASSES - 1)
                held += [code + before, code + CLASSES + cls[here + 1]]
                size += 2 * len(here)
                if size > _FLUSH:
                    yield counted()
                    held, size = [], 0
        yield counted()

    return (training.select("text").mapInArrow(partial, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
            .select(F.expr(f"code div {2 * CLASSES}").alias("word"), (F.col("code") % (2 * CLASSES)).cast("int").alias("side"), "n"))


def best_class(n: np.ndarray, step: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The class in which each row's context counts are most likely; never that of ends."""
    total = n[:, :CLASSES].sum(axis=1, keepdims=True)
    gain = n[:, :CLASSES] @ np.log(step) + n[:, CLASSES:] @ np.log(step).T - total * np.log(size + total)
    gain[:, -1] = -np.inf
    return gain.argmax(axis=1)


def exchanged(training: DataFrame, lexicon: Lexicon, of: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class of each known word: its unit's, or the best one for what stands around it."""
    shared = training.sparkSession.sparkContext.broadcast((transitions(m), m.sum(axis=0)))

    @given_back
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, size = shared.value
        for batch in batches:
            n = np.zeros((batch.num_rows, 2 * CLASSES))
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch["around"].offsets.to_numpy()))
            around = batch["around"].flatten()
            n[row, around.field("side").to_numpy()] = around.field("n").to_numpy()
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(best_class(n, step, size).astype(np.int32))], names=["word", "class"])

    around = contexts(training, lexicon, of).groupBy("word").agg(F.collect_list(F.struct("side", "n")).alias("around"))  # 2 * CLASSES at most
    found = around.mapInArrow(choose, "word long, class int").toPandas()  # KNOWN rows at most
    out = np.where(lexicon.units >= 0, of[np.maximum(lexicon.units, 0)], -1).astype(np.int16)
    out[found["word"].to_numpy(np.int64)] = found["class"].to_numpy(np.int16)
    out[lexicon.counts < EVIDENCE] = -1
    return out


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    classes: np.ndarray  # of each known word, -1 where it has too few contexts
    of: np.ndarray  # class of each shape, then of the end
    step: np.ndarray  # log10 of class transitions
    emit: np.ndarray  # log10 of each known word in its class
    emit_shape: np.ndarray  # of shapes and the end in their classes
    shape_total: np.ndarray  # of each shape: tokens + distinct words without a class + 1

    def placed(self, words: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place in the lexicon, whether it is known, whether it has a class of its own, class and log10 in the class of each word."""
        at, found = self.lexicon.look_up(words)
        if not len(self.classes):
            return at, found, found, self.of[shapes], self.emit_shape[shapes]
        own = found & (self.classes[at] >= 0)
        return at, found, own, np.where(own, self.classes[at], self.of[shapes]), np.where(own, self.emit[at], self.emit_shape[shapes])


def class_counts(training: DataFrame, lexicon: Lexicon, classes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each class follows each other one, with a class for every known word."""
    shared = training.sparkSession.sparkContext.broadcast((tuple(vars(lexicon).values()), classes, of))

    @given_back
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, (classes, of) = Lexicon(*shared.value[0]), shared.value[1:]
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for _, _, words, shapes, first in tokens(batch["text"]):
                at, found = lexicon.look_up(words)
                own = found & (classes[at] >= 0) if len(classes) else found
                cls, _ = with_ends(np.where(own, classes[at], of[shapes]) if len(classes) else of[shapes], first, CLASSES - 1)
                counts += np.bincount(np.concatenate([[CLASSES - 1], cls[:-1]]).astype(np.int64) * CLASSES + cls, minlength=CLASSES * CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["pair", "n"])

    out = np.zeros(CLASSES * CLASSES)
    for r in training.select("text").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(CLASSES, CLASSES)


def model_of(lexicon: Lexicon, classes: np.ndarray, of: np.ndarray, m: np.ndarray, shape_size: np.ndarray, shape_total: np.ndarray) -> Model:
    """``of``: classes of shapes and the end; ``m``: class pair counts; ``shape_size``: training tokens of words without a class, by shape."""
    size = np.append(shape_size, lexicon.docs)
    own = classes >= 0
    in_class = np.bincount(classes[own], lexicon.counts[own] + ADD, CLASSES) + np.bincount(of, size + ADD, CLASSES)
    emit = np.log10((lexicon.counts + ADD) / in_class[classes]) if len(classes) else np.empty(0)
    return Model(lexicon, classes, of, np.log10(transitions(m)), emit, np.log10((size + ADD) / in_class[of]), shape_total)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    A null text is an empty one: its end alone.  Without training rows all counts are 0 and every
    word shares the mass of unseen ones.  Repeated rows and null ids give a row each, an empty
    table none; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       held_out.alias("held_out"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    training = docs.where("not held_out")
    words = saved(vocabulary(training))
    n_docs = training.count()
    all_n, all_v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    known_from, unit_from = _at_least(words, KNOWN), _at_least(words, UNIT_WORDS)
    known = words.where(F.col("c") >= known_from).select("word", "c").toPandas()  # KNOWN rows at most
    order = np.argsort(known["word"].to_numpy(np.int64).view(np.uint64))
    counts = known["c"].to_numpy(np.int64)[order]
    units = np.full(len(counts), -1, np.int64)
    frequent = np.flatnonzero(counts >= unit_from)
    units[frequent] = np.arange(len(frequent))
    lexicon = Lexicon(known["word"].to_numpy(np.int64).view(np.uint64)[order], counts, units, all_n + n_docs, all_v + (n_docs > 0), n_docs)
    # a handful of contexts says too little of a word's class
    shapes = words.where(F.col("c") < max(known_from, EVIDENCE)).groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    shape_size, shape_total = np.zeros(SHAPES), np.ones(SHAPES)
    for r in shapes:
        shape_size[r["shape"]] += r["c"]
        shape_total[r["shape"]] += r["c"] + r["v"]
    pairs = pair_counts(training, lexicon)
    of = exchange(pairs)
    member = np.eye(CLASSES)[of]
    classes = exchanged(training, lexicon, of, member.T @ pairs @ member)
    of = of[UNIT_WORDS:]  # shapes and the end
    model = model_of(lexicon, classes, of, class_counts(training, lexicon, classes, of), shape_size, shape_total)
    give_back()  # the driver's tables
    shared = docs.sparkSession.sparkContext.broadcast((tuple(vars(lexicon).values()), *list(vars(model).values())[1:]))
    base = float(np.log10(lexicon.n + lexicon.v + 1))

    @given_back
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, seen = Lexicon(*shared.value[0]), set()
        model = Model(lex, *shared.value[1:])
        log_shape, log_end = np.log10(model.shape_total), np.log10(lex.docs + 1) - base
        for batch in batches:
            th, out = batch["th"].to_pylist(), []
            for at, to, hashes, shape, first in tokens(batch["text"]):
                n = to - at
                index, found, own, cls, emit = model.placed(hashes, shape)
                count = lex.counts[index] * found if len(lex.counts) else np.zeros(len(hashes), np.int64)
                row = np.repeat(np.arange(n), np.diff(first))
                log_count = np.log10(count + 1.0)
                plain = np.bincount(row, np.where(found, log_count - base, 0), n) + log_end
                cls, owner = with_ends(cls.astype(np.int64), first, CLASSES - 1)
                emit = np.where(found & ~own, emit + log_count - log_shape[shape], emit)
                emit, _ = with_ends(emit, first, model.emit_shape[-1])
                total = np.bincount(owner, model.step[np.concatenate([[CLASSES - 1], cls[:-1]]), cls] + emit, n)
                n_known = np.bincount(row, found, n).astype(np.int64) + (lex.docs > 0)
                # words that only the join knows, once for each text of a task
                rare = np.flatnonzero(~found)
                cut = np.searchsorted(rare, first)
                for i in range(n):
                    mine = rare[cut[i]:cut[i + 1]]
                    new = th[at + i] not in seen
                    seen.add(th[at + i])
                    w, f, m = np.unique(hashes[mine], return_index=True, return_counts=True) if new else (hashes[:0], mine[:0], mine[:0])
                    out.append((int(first[i + 1] - first[i]) + 1, int(n_known[i]), float(plain[i]), float(total[i]), new and bool(len(mine)),
                                w.view(np.int64), shape[mine[f]].astype(np.int32), m.astype(np.int32)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], batch["th"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             names=["doc_id", "held_out", "th", "n_tokens", "n_known", "plain", "total", "rare", "w", "s", "m"])

    rows = saved(docs.select("doc_id", "held_out", "th", "text").mapInArrow(
        scored, "doc_id long, held_out boolean, th long, n_tokens long, n_known long, plain double, total double, rare boolean, "
                "w array<long>, s array<int>, m array<int>"))
    rare = rows.where("rare").select("th", F.explode(F.arrays_zip("w", "s", "m")).alias("r")).select(
        "th", F.col("r.w").alias("word"), F.col("r.s").alias("s"), F.col("r.m").alias("m"))
    totals = docs.sparkSession.createDataFrame([(i, float(np.log10(t))) for i, t in enumerate(shape_total)], "s int, log_total double")
    seen = (rare.join(words.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
            .join(F.broadcast(totals), "s")  # one row per shape
            .groupBy("th").agg(F.sum(F.col("m") * (F.log10(F.col("c") + 1) - base)).alias("plain_"),
                               F.sum(F.col("m") * (F.log10(F.col("c") + 1) - F.col("log_total"))).alias("total_"),
                               F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known_")))
    # tasks that hold the same text have each given its words
    times = rows.where("rare").groupBy("th").agg(F.count(F.lit(1)).alias("times"))
    seen = seen.join(times, "th")

    def more(column):
        return F.coalesce(F.col(column) / F.col("times"), F.lit(0))

    return rows.join(seen, "th", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("known_")).cast("long").alias("n_known"),
        F.lit(int(lexicon.n)).cast("long").alias("train_tokens"), (F.col("plain") + more("plain_")).alias("base_score"),
        (F.col("total") + more("total_")).alias("score"))
