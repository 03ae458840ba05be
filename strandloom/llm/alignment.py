"""Alignment of two tokenizers' tokens on the same bytes, by products of incidence matrices.

For a block of texts the tokens of each side are the rows of a matrix in compressed rows (CSR)
whose columns are bytes.  The row products of A with the transpose of B (Gustavson's order: row i
is the sum of the rows of the transpose that row i of A points at) give the overlap links, with
the number of bytes that two tokens share.  Byte offsets where tokens of both sides end cut the
tokens into groups, and the product of the group-incidence matrices gives the shared-group links.
The links whose byte ranges end together are the overlap links at the ends of groups.

How often a pair of ids is linked in the whole corpus is summed by Spark from partial counts of
tasks.  Pairs above a count, at most FREQUENT of them, are handed to all tasks; what a document
holds of rarer pairs is joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import bytebpe
from strandloom.llm.bytebpe import Merges
from strandloom.llm.memory import given_back
from strandloom.session import saved

#: Terms of a product that are expanded at a time.
TERMS = 1 << 20
#: Id pairs whose counts are broadcast (24 bytes each); all others are joined.
FREQUENT = 1 << 18
#: Bytes of text that are aligned at a time; a longer text is a block of its own.
TOGETHER = 1 << 19
#: Bytes of units remembered for each side in each Python worker.
MEMO_BYTES = 32 << 20
_ENTRY = 200  # bytes of a unit beside its letters and ids
_HELD = 1 << 20  # id pairs that a task holds before it hands on their counts


class Csr(NamedTuple):
    """A sparse matrix in compressed rows."""

    start: np.ndarray  # rows + 1
    column: np.ndarray
    value: np.ndarray
    width: int


def incidence(column: np.ndarray, start: np.ndarray, width: int) -> Csr:
    """A matrix of ones."""
    return Csr(start, column, np.ones(len(column), np.int64), width)


def byte_incidence(ends: np.ndarray, width: int) -> Csr:
    """Tokens by bytes: token k holds the bytes from the end of the one before it to its own."""
    return incidence(np.arange(width), np.concatenate([[0], ends]).astype(np.int64), width)


def group_incidence(ends: np.ndarray, bounds: np.ndarray) -> Csr:
    """Tokens by groups: each token is in the group that ends at or after it."""
    return incidence(np.searchsorted(bounds, ends), np.arange(len(ends) + 1), len(bounds))


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.column, kind="stable")
    row = np.repeat(np.arange(len(m.start) - 1), np.diff(m.start))
    start = np.concatenate([[0], np.cumsum(np.bincount(m.column, minlength=m.width))])
    return Csr(start, row[order], m.value[order], len(m.start) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """``a`` times ``b``, row by row, some rows at a time; columns ascend in each row."""
    terms = np.diff(b.start)[a.column]  # of each entry of a
    reach = np.concatenate([[0], np.cumsum(terms)])
    rows = len(a.start) - 1
    of_row = reach[a.start]  # terms before each row
    columns, values, counts, row = [], [], np.zeros(rows, np.int64), 0
    while row < rows:
        to = max(row + 1, int(np.searchsorted(of_row, of_row[row] + TERMS, "right")) - 1)
        entry = slice(int(a.start[row]), int(a.start[to]))
        n = terms[entry]
        at = np.repeat(b.start[a.column[entry]] - (reach[entry] - reach[entry.start]), n) + np.arange(int(n.sum()))
        owner = np.repeat(np.repeat(np.arange(row, to), np.diff(a.start[row:to + 1])), n)
        key = owner * b.width + b.column[at]
        value = np.repeat(a.value[entry], n) * b.value[at]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        columns.append(key[first] % b.width)
        values.append(np.add.reduceat(value, first) if len(first) else value)
        counts[row:to] = np.bincount(key[first] // b.width - row, minlength=to - row)
        row = to
    none = np.empty(0, np.int64)
    return Csr(np.concatenate([[0], np.cumsum(counts)]), np.concatenate([none, *columns]), np.concatenate([none, *values]), b.width)


def pairs(m: Csr) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each entry."""
    return np.repeat(np.arange(len(m.start) - 1), np.diff(m.start)), m.column


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray) -> Csr:
    """Tokens of A by tokens of B that share bytes, with the number of bytes; both cover the same bytes."""
    width = int(a_ends[-1]) if len(a_ends) else 0
    return product(byte_incidence(a_ends, width), transposed(byte_incidence(b_ends, width)))


def shared_group_links(a_ends: np.ndarray, b_ends: np.ndarray, bounds: np.ndarray) -> Csr:
    """Tokens of A by tokens of B in the same group."""
    return product(group_incidence(a_ends, bounds), transposed(group_incidence(b_ends, bounds)))


class Side:
    """One tokenizer: units of a text that are encoded on their own, remembered as packed ids."""

    def __init__(self, size: int):
        self.size, self.held = size, 0
        self.memo: dict[str, bytes | None] = {}
        self.odd = False  # whether some unit has not come back as it was
        self.length = np.zeros(size, np.int64)  # bytes of each token

    def units(self, text: str) -> Iterator[list[str]]:
        raise NotImplementedError

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Ids of units one after the other, where each unit's start (n + 1), and their joined bytes."""
        raise NotImplementedError

    def remember(self, parts: Sequence[list[str]]) -> None:
        """Encodes the units that are not remembered, all together."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        new = list(set().union(*parts).difference(self.memo))
        if not new:
            return
        ids, start, joined = self.fresh(new)
        packed, raw = ids.astype("<u4").tobytes(), [u.encode() for u in new]
        at = np.concatenate([[0], np.cumsum(self.length[ids])])[start]
        first, last = (4 * start[:-1]).tolist(), (4 * start[1:]).tolist()
        if joined == b"".join(raw) and np.array_equal(np.diff(at), list(map(len, raw))):
            self.memo.update(zip(new, [packed[i:j] for i, j in zip(first, last, strict=True)], strict=True))
        else:  # some units do not come back as they were
            spans, self.odd = at.tolist(), True
            for k, (unit, own) in enumerate(zip(new, raw, strict=True)):
                self.memo[unit] = packed[first[k]:last[k]] if joined[spans[k]:spans[k + 1]] == own else None
        self.held += len(packed) + sum(map(len, raw)) + len(new) * _ENTRY

    def encode(self, texts: Sequence[str | None]) -> list[bytes | None]:
        """Packed ids of texts, None for a null text and where their bytes differ from the text's own."""
        out: list[list[bytes | None]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            nonlocal waiting, size
            self.remember([units for _, units in waiting])
            for row, units in waiting:
                found = list(map(self.memo.__getitem__, units))
                out[row].append(None if self.odd and None in found else b"".join(found))
            waiting, size = [], 0

        for row, text in enumerate(texts):
            if text is None:
                out[row].append(None)
                continue
            for units in self.units(text):
                waiting.append((row, units))
                size += len(units)
                if size >= bytebpe.TOGETHER:
                    settle()
        settle()
        return [None if None in parts else b"".join(parts) for parts in out]


class ByteSide(Side):
    """Byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.merges = Merges.of(path)
        super().__init__(len(self.merges.token))
        self.length[:] = self.merges.length
        self.units = self.merges.split

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
        ids, start = self.merges.merged([u.encode() for u in units])
        return ids, start, b"".join(map(self.merges.token.__getitem__, ids.tolist()))


class PieceSide(Side):
    """Pieces that never hold a space after another character, so texts are cut before each run of spaces."""

    _UNITS = re.compile(" *[^ ]+| +")

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        super().__init__(self.model.get_piece_size())
        self.token = [self._bytes(i) for i in range(self.size)]
        self.length[:] = [len(t) for t in self.token]
        self.cuts = not any(b" " in t.lstrip(b" ") for t in self.token)
        self.space = self.model.piece_to_id("▁")

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def units(self, text: str) -> Iterator[list[str]]:
        if not self.cuts:
            yield [text]
        elif len(text) <= TOGETHER:
            yield self._UNITS.findall(text)
        else:
            found = self._UNITS.finditer(text)
            while part := [m.group() for m in islice(found, bytebpe.TOGETHER)]:
                yield part

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
        """The model puts a space in front itself; of a lone space nothing would be left."""
        ids = self.model.encode([u[1:] for u in units], num_threads=1)
        ids = [[self.space] if u == " " else i for u, i in zip(units, ids, strict=True)]
        start = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(start[-1]))
        return flat, start, b"".join(map(self.token.__getitem__, flat.tolist()))


class Aligned(NamedTuple):
    """Tokens and links of a block of texts; ``of_*`` say where each text's tokens, groups and links start (n + 1)."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    of_group: np.ndarray
    link_a: np.ndarray  # positions of linked tokens
    link_b: np.ndarray
    of_link: np.ndarray
    of_overlap: np.ndarray
    of_shared: np.ndarray


def aligned(tokens: Sequence[tuple[bytes, bytes]], a_length: np.ndarray, b_length: np.ndarray) -> Aligned:
    """``tokens``: packed ids of both sides for each text; their bytes must agree text by text."""
    sides = []
    for k, length in ((0, a_length), (1, b_length)):
        ids = np.frombuffer(b"".join(t[k] for t in tokens), "<u4").astype(np.int64)
        start = np.concatenate([[0], np.cumsum([len(t[k]) // 4 for t in tokens])]).astype(np.int64)
        sides.append((ids, start, np.cumsum(length[ids])))
    (a, of_a, a_ends), (b, of_b, b_ends) = sides
    met = np.minimum(np.searchsorted(b_ends, a_ends), max(len(b_ends) - 1, 0))
    bounds = a_ends[b_ends[met] == a_ends] if len(b_ends) else a_ends  # texts end there, so no group holds two
    x, y = pairs(overlap_links(a_ends, b_ends))
    together = a_ends[x] == b_ends[y]
    links = np.concatenate([[0], np.cumsum(together)])
    of_overlap = np.searchsorted(x, of_a)
    ends = np.concatenate([[0], a_ends])[of_a]
    a_group, b_group = group_incidence(a_ends, bounds), group_incidence(b_ends, bounds)
    # row sums of the product of the group incidences: each row of A's points at one group, whose row of the
    # transpose has as many entries as the group has tokens of B
    shared = np.concatenate([[0], np.cumsum(np.bincount(b_group.column, minlength=b_group.width)[a_group.column])])
    return Aligned(a, b, of_a, of_b, a_group.column, b_group.column, np.searchsorted(bounds, ends, "right"),
                   x[together], y[together], links[of_overlap], of_overlap, shared[of_a])


class Printer:
    """Groups as text: ids of a side joined by commas, sides by a bar, groups by a semicolon."""

    def __init__(self, size: int):
        self.size = size
        self.part = [f"{i}{mark}" for mark in ",|;" for i in range(size)]

    def digests(self, block: Aligned) -> list[str]:
        """SHA-256 of each text's groups, empty without tokens."""
        n, m = len(block.a), len(block.b)
        groups = int(block.of_group[-1])
        before_b = np.concatenate([[0], np.cumsum(np.bincount(block.b_group, minlength=groups))])
        upto_a = np.cumsum(np.bincount(block.a_group, minlength=groups))
        flat = np.empty(n + m, np.int64)
        a_last = np.append(block.a_group[1:] != block.a_group[:-1], [True] * min(1, n))
        b_last = np.append(block.b_group[1:] != block.b_group[:-1], [True] * min(1, m))
        flat[np.arange(n) + before_b[block.a_group]] = block.a + self.size * a_last
        flat[np.arange(m) + upto_a[block.b_group]] = block.b + 2 * self.size * b_last
        words, at = list(map(self.part.__getitem__, flat.tolist())), block.of_a + block.of_b
        return [hashlib.sha256("".join(words[i:j])[:-1].encode()).hexdigest() if j > i else ""
                for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def _printer(size: int, cache: dict = {}) -> Printer:  # noqa: B006  one for each worker
    if size not in cache:
        cache[size] = Printer(size)
    return cache[size]


def _side(kind: type[Side], path: str, cache: dict = {}) -> Side:  # noqa: B006  one for each worker
    if (kind, path) not in cache:
        cache[kind, path] = kind(path)
    return cache[kind, path]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return bytebpe.default_path(), public_tokenizers.path("piece_bpe_32k.model")


def _blocks(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, some at a time; null as empty."""
    block, size = [], 0
    for value in column:
        text = value.as_py() or ""
        if block and size + len(text) > TOGETHER:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared")


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row, doc_id, the counts, groups_sha256 and ``links``: the linked id pairs of each row of ``docs``, packed as a * 2**32 + b."""
    @given_back
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _side(ByteSide, a_path), _side(PieceSide, b_path)
        printer = _printer(max(a.size, b.size))
        for batch in batches:
            row = 0
            for texts in _blocks(batch["text"]):
                led = [" " + t if t else None for t in texts]
                on_b = b.encode(led)
                on_a = a.encode([t if y is not None else None for t, y in zip(led, on_b, strict=True)])
                tokens = [(x, y) if x is not None and y is not None else (b"", b"") for x, y in zip(on_a, on_b, strict=True)]
                block = aligned(tokens, a.length, b.length)
                key = (block.a[block.link_a] << 32 | block.b[block.link_b]).astype("<i8")
                links = [key[i:j].tobytes() for i, j in zip(block.of_link, block.of_link[1:])]
                counts = [pa.array(np.diff(c)) for c in (block.of_a, block.of_b, block.of_group, block.of_link, block.of_overlap, block.of_shared)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].slice(row, n), batch["doc_id"].slice(row, n), *counts, pa.array(printer.digests(block), pa.string()),
                     pa.array(links, pa.binary())], names=["row", "doc_id", *_COUNTS, "groups_sha256", "links"])
                row += n

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(align, f"row long, doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, links binary")


@given_back
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of id pairs."""
    def handed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)  # exact below 2**53

    key, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        raw = b"".join(v for v in batch["links"].to_pylist() if v)
        for at in range(0, len(raw), 8 * TERMS):
            own, count = np.unique(np.frombuffer(raw[at:at + 8 * TERMS], "<i8"), return_counts=True)
            key, n = handed([key, own], [n, count])
            if len(key) > _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])
                key, n = key[:0], n[:0]
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, a, b, n: how many links hold the ids linked, and ``best``: whether no other A id is linked more often with b."""
    counts = saved(rows.select("links").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
                   .select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(2**32 - 1).alias("b"), "n"))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    return counts.join(most, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _threshold(counts: DataFrame) -> float:
    """The least power of 2 ** (1 / 8) that FREQUENT pairs at most reach."""
    step = F.floor(F.log2("n") * 8 + 1e-9)
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True):  # 8 * 63 rows at most
        held += r["rows"]
        if held > FREQUENT:
            break
        least = r["step"]
    return float("inf") if least is None else 2 ** ((least - 0.5) / 8)


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps and n_shared of every row of ``docs`` (doc_id, text).

    ``n_links`` counts token pairs whose byte ranges end together, ``n_overlaps`` those that share
    bytes, ``n_shared`` those in the same group.  A text that is null or empty, or whose tokens do not give its bytes back on both
    sides, has no tokens: zeros and an empty digest.  Repeated rows and null ids give a row each
    and all count; an empty table gives none; other columns are ignored.
    """
    a_default, b_default = default_paths()
    rows = saved(linked(docs, a_path or a_default, b_path or b_default))
    table = saved(pair_counts(rows))
    cut = _threshold(table)
    top = table.where(F.col("n") >= cut).select("pair", "n", "best").toPandas().sort_values("pair")  # FREQUENT rows at most
    shared = rows.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy(np.int64) for c in ("pair", "n", "best")))

    @given_back
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, best = shared.value
        for batch in batches:
            n_best, total, rest = [], [], []
            for raw in batch["links"].to_pylist():
                own, times = np.unique(np.frombuffer(raw or b"", "<i8"), return_counts=True)
                at = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
                hit = key[at] == own if len(key) else np.zeros(len(own), bool)
                n_best.append(int((times[hit] * best[at[hit]]).sum()))
                total.append(int((times[hit] * count[at[hit]]).sum()))
                rest.append([{"pair": p, "times": t} for p, t in zip(own[~hit].tolist(), times[~hit].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, kind)],
                                             names=["row", "n_best", "count_sum", "rest"])

    scored = saved(rows.select("row", "links").mapInArrow(
        score, "row long, n_best long, count_sum long, rest array<struct<pair:long,times:long>>"))
    rare = (scored.select("row", F.inline("rest")).join(table.where(F.col("n") < cut), "pair")
            .select("row", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")))
    sums = scored.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("links").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared")
