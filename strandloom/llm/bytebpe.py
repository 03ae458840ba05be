"""Byte-level BPE by rank-synchronous merging of ragged arrays, and token counts of documents.

Texts are cut into pre-tokens by the vocabulary's pattern.  Pre-tokens that are not remembered
are held together as one ragged array of symbols, and all sequences merge at the same time: in
each round every sequence takes its own lowest-ranked pair and merges all of its occurrences.
Sequences without any pair left leave the array; what survives are the tokens.

A merge joins neighbouring bytes only where some token of the vocabulary holds these two bytes
side by side.  Sequences are parted everywhere else first, so that very long ones fall apart into
pieces that merge on their own.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.memory import given_back
from strandloom.llm.tokens import byte_letters

#: Pre-tokens that are counted or merged together, and characters of a text that are cut at a time.
TOGETHER = 1 << 16
#: Bytes that the pre-tokens remembered in each Python worker take; beyond it the memo starts anew.
MEMO_BYTES = 24 << 20
_ENTRY = 104  # bytes of a dict entry beside its key and value
#: Fixed: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed: the same for texts of Latin-1 characters, whose letters and numbers can be listed.
_LATIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"""
_NONE = np.int64(1) << 40  # rank of a pair that no merge joins
_loaded: dict[str, Merges] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Merges:
    """The merges of a vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, byte_of = spec["model"], {c: b for b, c in byte_letters().items()}
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        #: bytes of each token; those of added tokens, which texts only hold as strings, are empty
        self.token = [b""] * size
        for name, i in vocab.items():
            if all(c in byte_of for c in name):
                self.token[i] = bytes(byte_of[c] for c in name)
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_id = np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left, right, new = (np.array([vocab[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        order = np.argsort(key := left << 32 | right, kind="stable")
        self.key, self.rank, self.new = key[order], order.astype(np.int64), new
        # all occurrences of a pair may merge at once if no merge is older than what makes its parts
        made = np.full(size, -1, np.int64)
        np.maximum.at(made, new, np.arange(len(new)))
        self.ordered = bool((np.maximum(made[left], made[right]) < np.arange(len(new))).all())
        self.inside = np.zeros((256, 256), bool)
        for token in self.token:
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.pattern, self.latin = regex.compile(PATTERN), re.compile(_LATIN)
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.counts: dict[str, int] = {}
        self.held = 0

    @staticmethod
    def of(path: str) -> Merges:
        """The merges of this process."""
        if path not in _loaded:
            _loaded[path] = Merges(path)
        return _loaded[path]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def merged(self, sequences: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all sequences one after the other, where each sequence starts in them; n + 1)."""
        start = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
        raw = np.frombuffer(b"".join(sequences), np.uint8)
        n = len(raw)
        if not n:
            return np.empty(0, np.int64), np.zeros(len(start), np.int64)
        symbol, at = self.byte_id[raw], np.arange(n)
        head = np.zeros(n, bool)
        head[start[:-1][start[:-1] < n]] = True
        head[1:] |= ~self.inside[raw[:-1], raw[1:]]
        rank = np.full(n, _NONE)  # of the pair that begins here
        rank[:-1] = np.where(head[1:], _NONE, self.ranks(symbol[:-1], symbol[1:]))
        done_symbol, done_at = [], []
        while len(symbol):
            first = np.flatnonzero(head)
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbol))))
            active = low < _NONE
            if not active.all():
                done_symbol.append(symbol[~active])
                done_at.append(at[~active])
                symbol, at, head, rank, low = symbol[active], at[active], head[active], rank[active], low[active]
                if not len(symbol):
                    break
            hit = rank == low
            run = np.arange(len(hit))
            if self.ordered:  # of overlapping occurrences every other one, from the left
                begins = hit & ~np.concatenate([[False], hit[:-1]])
                hit &= (run - np.maximum.accumulate(np.where(begins, run, 0))) % 2 == 0
            else:
                first = np.flatnonzero(head)
                places = np.minimum.reduceat(np.where(hit, run, len(hit)), first)
                hit = np.zeros(len(hit), bool)
                hit[places] = True
            symbol[hit] = self.new[rank[hit]]
            kept = np.ones(len(hit), bool)
            kept[1:] = ~hit[:-1]
            stale = hit | np.concatenate([(hit & ~head)[1:], [False]]) | np.concatenate([(hit & ~head)[2:], [False] * min(2, len(hit))])
            symbol, at, head, rank, stale = symbol[kept], at[kept], head[kept], rank[kept], np.flatnonzero(stale[kept])
            last = stale == len(symbol) - 1
            follow = np.minimum(stale + 1, len(symbol) - 1)
            rank[stale] = np.where(last | head[follow], _NONE, self.ranks(symbol[stale], symbol[follow]))
        symbol, at = np.concatenate(done_symbol), np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        return symbol[order], np.searchsorted(at[order], start)

    def split(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text in order, some at a time."""
        pattern = self.latin if _is_latin(text) else self.pattern
        if pattern is self.pattern and any(unicodedata.category(c) == "Cn" for c in set(text)):
            from tokenizers import pre_tokenizers  # of another Unicode version than the pattern's

            cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
            yield [text[a:b] for _, (a, b) in cut]
        elif len(text) <= TOGETHER:
            yield pattern.findall(text)
        else:
            found = pattern.finditer(text)
            while part := [m.group() for m in islice(found, TOGETHER)]:
                yield part

    def remember(self, parts: Iterable[Sequence[str]]) -> None:
        """Merges the pre-tokens that are not remembered."""
        if self.held > MEMO_BYTES:
            self.counts.clear()
            self.held = 0
        fresh = list(set().union(*parts).difference(self.counts))
        _, start = self.merged([p.encode() for p in fresh])
        self.counts.update(zip(fresh, np.diff(start).tolist(), strict=True))
        self.held += sum(map(sys.getsizeof, fresh)) + len(fresh) * _ENTRY

    def count(self, texts: Iterable[str]) -> np.ndarray:
        """Tokens of each text; the strings of special tokens count as one each."""
        total: list[int] = []
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            nonlocal waiting, size
            self.remember([p for _, p in waiting])
            for row, part in waiting:
                total[row] += sum(map(self.counts.__getitem__, part))
            waiting, size = [], 0

        for row, text in enumerate(texts):
            pieces = self.apart.split(text) if self.apart else [text]
            total.append(len(pieces) - 1)
            for piece in pieces:
                for part in self.split(piece):
                    waiting.append((row, part))
                    size += len(part)
                    if size >= TOGETHER:
                        settle()
        settle()
        return np.array(total, np.int64)


def count_tokens(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit``) of every row of ``docs`` (doc_id, text).

    A null text counts as empty: no bytes and no tokens.  Repeated rows and null ids give a row
    each, an empty table none; other columns are ignored.
    """
    path = path or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    @given_back
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(merges.count(t.as_py() for t in batch["text"]), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    out = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
