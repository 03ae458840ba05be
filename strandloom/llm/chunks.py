"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last bytes has some zero bits, so passages that texts
share are cut alike wherever they stand.  A chunk that occurs more than once is encoded once and
its ids are joined to the texts that hold it; other stretches are encoded in place.  A cut may
part a word: the ids at such a join are wrong, so the word around it is put together from as
many chunks as it runs through, up to white space on both sides, and encoded again.  Ids never
depend on anything across white space, so the repaired ids agree exactly with those of the whole.

Which texts hold repeated chunks is first asked of a bitset of fixed size: texts without any are
finished where they are read, and only the others are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokens import WordEncoder, default_path
from strandloom.llm.words import mix, powers, text_blocks
from strandloom.session import saved

#: Bytes of the rolling window; a cut comes after 2**CUT_BITS bytes on average.
WINDOW, CUT_BITS = 16, 10
#: The bitset has 2**SLOT_BITS words of 64 bits: 4 MB.
SLOT_BITS = 19
#: Fixed: the characters that part words, as in the encoder's split.
_GAP = frozenset(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions in a block of texts before which a chunk starts, each text's start and end included."""
    edges = np.unique(offsets)
    if len(raw) <= WINDOW:
        return edges
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=total[1:])
    rolling = mix((total[WINDOW:] - total[:-WINDOW]) * down[:len(raw) + 1 - WINDOW])
    at = np.flatnonzero((rolling & np.uint64((1 << CUT_BITS) - 1)) == 0) + WINDOW
    at = at[at < len(raw)]
    at = at[(raw[at] & 0xC0) != 0x80]  # between characters
    start = offsets[np.searchsorted(offsets, at, "right") - 1]
    return np.union1d(edges, at[at - start >= WINDOW])  # a window lies inside its text


def text_chunks(column: pa.Array) -> Iterator[tuple[int, list[tuple[bytes, tuple[int, int]]]]]:
    """(row, its chunks with their 128-bit digests as two longs) for each row of a text column."""
    for at, to, raw, offsets in text_blocks(column):
        where, data = cuts(raw, offsets), raw.tobytes()
        first = np.searchsorted(where, offsets)
        for row in range(at, to):
            here = where[first[row - at]:first[row - at + 1] + 1].tolist()
            parts = [data[a:b] for a, b in zip(here, here[1:])]
            yield row, [(p, tuple(np.frombuffer(hashlib.blake2b(p, digest_size=16).digest(), "<i8").tolist())) for p in parts]


def _longs(pairs) -> list[pa.Array]:
    a, b = zip(*pairs, strict=True) if pairs else ([], [])
    return [pa.array(a, pa.int64()), pa.array(b, pa.int64())]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [k for _, parts in text_chunks(batch["text"]) for _, k in parts]
        yield pa.RecordBatch.from_arrays(_longs(keys), names=["h1", "h2"])


def held(bits: np.ndarray, h1: int) -> bool:
    """Whether the bitset has a chunk's bit."""
    return bool(int(bits[(h1 >> 6) & ((1 << SLOT_BITS) - 1)]) >> (h1 & 63) & 1)


def bitset(shared: DataFrame) -> np.ndarray:
    slots = shared.groupBy(F.shiftright("h1", 6).bitwiseAND((1 << SLOT_BITS) - 1).alias("slot")).agg(
        F.expr("bit_or(shiftleft(1L, cast(h1 & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << SLOT_BITS, np.uint64)
    out[slots["slot"].to_numpy(np.int64)] = slots["bits"].to_numpy(np.int64).view(np.uint64)
    return out


class Codec:
    """Digests of ids and of decoded text, with the decoding table of one tokenizer."""

    def __init__(self, path: str):
        self.encoder = WordEncoder.of(path)
        size = max(self.encoder.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.token = [self.encoder.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.decimal = [str(i) for i in range(size)]

    def decode(self, ids: list[int]) -> str:
        """As the library: the file names no decoder, so tokens are joined by one space."""
        return " ".join(map(self.token.__getitem__, ids))

    def digest(self, packed: bytes) -> tuple[int, str, str]:
        ids = np.frombuffer(packed, "<u4").tolist()
        return (len(ids), hashlib.sha256(" ".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest(),
                hashlib.sha256(self.decode(ids).encode()).hexdigest())

    def edges(self, text: str) -> tuple[int, int]:
        """Where the first white space of a chunk is and where the last one ends; -1, -1 without any."""
        head = next((i for i, c in enumerate(text) if c in _GAP), -1)
        return head, len(text) - next((i for i, c in enumerate(reversed(text)) if c in _GAP), 0) if head >= 0 else -1

    def encode_chunk(self, text: str) -> tuple[bytes, int, int]:
        """Ids of a chunk on its own, and how many bytes of them its first and last word fragments take."""
        head, tail = self.edges(text)
        if head < 0:
            return b"", 0, 0
        parts = [self.encoder.encode(x) for x in (text[:head], text[head:tail], text[tail:])]
        return b"".join(parts), len(parts[0]), len(parts[2])

    def assemble(self, parts: list[tuple[str, tuple[bytes, int, int] | None]]) -> bytes:
        """Ids of a text from its stretches; those with known ids are not encoded again."""
        out, word, ids = [], "", b""  # the word fragment left open, and its ids when they are known
        for text, known in parts:
            head, tail = self.edges(text)
            if head < 0:
                word, ids = word + text, b""
                continue
            packed, n_head, n_tail = known or self.encode_chunk(text)
            if word and head:  # the cut parted a word: encode it again as a whole
                out.append(self.encoder.encode(word + text[:head]))
            else:
                out.append((ids or self.encoder.encode(word)) + packed[:n_head])
            out.append(packed[n_head:len(packed) - n_tail])
            word, ids = text[tail:], packed[len(packed) - n_tail:]
        out.append(ids or self.encoder.encode(word))
        return b"".join(out)


def _codec(path: str, cache: dict = {}) -> Codec:  # noqa: B006  one for each worker
    if path not in cache:
        cache[path] = Codec(path)
    return cache[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs`` (doc_id, text).

    A null text counts as empty: no tokens, digests of the empty string.  Repeated rows and null
    ids give a row each; an empty table gives none; other columns are ignored.
    """
    path = path or default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = saved(docs.select("text").mapInArrow(_digests, "h1 long, h2 long")
                   .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"))
    bits = docs.sparkSession.sparkContext.broadcast(bitset(shared))  # fixed size

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            texts, rows = batch["text"].to_pylist(), []
            for row, parts in text_chunks(batch["text"]):
                if any(held(bits.value, k[0]) for _, k in parts):
                    key = np.frombuffer(hashlib.blake2b(texts[row].encode(), digest_size=16).digest(), "<i8").tolist()
                    rows.append((None, None, None, *key, texts[row]))
                else:
                    rows.append((*codec.digest(codec.encoder.encode(texts[row])), None, None, None))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "t1", "t2", "text"])

    passed = saved(docs.mapInArrow(first_pass, f"{_DIGEST}, t1 long, t2 long, text string"))
    waiting = passed.where("t1 is not null")
    texts = saved(waiting.select("t1", "t2", "text").dropDuplicates(["t1", "t2"]))  # copies are done once

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, rows = batch["t1"].to_pylist(), batch["t2"].to_pylist(), []
            for row, parts in text_chunks(batch["text"]):
                rows += {k: (*k, t1[row], t2[row], p) for p, k in parts if held(bits.value, k[0])}.values()
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.binary()), strict=True)],
                                             names=["h1", "h2", "t1", "t2", "part"])

    def encode_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            rows = [codec.encode_chunk(p.decode()) for p in batch["part"].to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch["h1"], batch["h2"], *(pa.array(c, t) for c, t in zip(
                columns, (pa.binary(), pa.int32(), pa.int32()), strict=True))], names=["h1", "h2", "ids", "n_head", "n_tail"])

    picked = "h1 long, h2 long, t1 long, t2 long, part binary"
    encoded = (texts.mapInArrow(pick, picked).select("h1", "h2", "part").dropDuplicates(["h1", "h2"])
               .mapInArrow(encode_once, "h1 long, h2 long, ids binary, n_head int, n_tail int"))
    known = (texts.mapInArrow(pick, picked).select("h1", "h2", "t1", "t2").join(encoded, ["h1", "h2"])
             .groupBy("t1", "t2").agg(F.collect_list(F.struct("h1", "h2", "ids", "n_head", "n_tail")).alias("known")))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            table, rows = batch["known"].to_pylist(), []
            for row, parts in text_chunks(batch["text"]):
                reuse = {(k["h1"], k["h2"]): (k["ids"], k["n_head"], k["n_tail"]) for k in table[row]}
                joined: list[tuple[str, tuple[bytes, int, int] | None]] = []
                fresh = b""
                for part, key in parts:
                    if key in reuse:
                        joined += [(fresh.decode(), None)] if fresh else []
                        joined.append((part.decode(), reuse[key]))
                        fresh = b""
                    else:
                        fresh += part
                joined += [(fresh.decode(), None)] if fresh else []
                rows.append(codec.digest(codec.assemble(joined)))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch["t1"], batch["t2"], *(pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.string(), pa.string()), strict=True))],
                names=["t1", "t2", "n_tokens", "ids_sha256", "decoded_sha256"])

    done = texts.join(known, ["t1", "t2"]).mapInArrow(
        assemble, "t1 long, t2 long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    final = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return passed.where("t1 is null").select(*final).unionByName(
        waiting.select("doc_id", "t1", "t2").join(done, ["t1", "t2"]).select(*final))
