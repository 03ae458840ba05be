"""Encoding, chunk reuse and packing against the tokenizers library itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandloom.llm import chunks, packing
from strandloom.llm.tokens import WordEncoder, default_path

ODD = ["", " ", "\n\t", None, "İstanbul ΑΣ Ας µm Ü ﬁ ẖ H̱ éx É", "<|endoftext|>x <|ENDOFTEXT|> a<|startoftext|>", "don't I'LL 'S a,'re,b x'",
       "a\x1cb a\x85b a b ½x ª 12,3 x_y", "ß STRASSE é 日本語 テスト 🙂🙂 à"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(default_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def corpus():
    rng = random.Random(5)
    words = ["the", "Rain", "éclair", "don't", "x" * 400, "12,5", "!!", "über", "日本", "áb", "<|endoftext|>", "plain", "of"]

    def prose(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", ""]) for _ in range(n))

    passage = prose(1500)
    texts = [prose(rng.randint(1, 300)) + passage[rng.randint(0, 40):] + prose(30) for _ in range(12)]
    texts += [texts[0]] * 3 + [prose(n) for n in (1, 5, 50, 3000)] + ["y" * 30000, "y" * 30000 + "z", *ODD]
    return list(enumerate(texts)) + [(None, "lost id"), (3, "repeated id"), (3, "repeated id")]


def test_words_encode_as_the_library(library):
    encoder = WordEncoder.of(default_path())
    for _, text in corpus():
        assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_chunk_reuse_agrees_with_the_library(spark, library):
    rows = [(d, t, 1, "clash") for d, t in corpus()]
    got = chunks.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, h1 int, t1 string").repartition(3)).collect()

    def want(d, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))

    assert sorted(map(repr, map(tuple, got))) == sorted(repr(want(d, t)) for d, t, *_ in rows)
    assert chunks.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_passages_are_cut_alike(spark):
    import pyarrow as pa

    passage = "".join(random.Random(1).choices("abcdefgh  é", k=20000))
    (_, a), (_, b) = chunks.text_chunks(pa.array(["start " + passage, "another beginning " + passage]))
    assert len({k for _, k in a} & {k for _, k in b}) >= len(a) - 2 > 5


def test_packing_holds_every_piece_once(spark, library):
    rows = [(d, t, 9) for d, t in corpus()]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)).collect()
    want = []
    for d, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 4096
    first_fit: list[int] = []
    for n in sorted((r["length"] for r in got), reverse=True):
        at = next((i for i, used in enumerate(first_fit) if used + n <= 4096), None)
        if at is None:
            first_fit.append(n)
        else:
            first_fit[at] += n
    assert len(bins) <= len(first_fit)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_fills_bins_on_random_histograms():
    rng = random.Random(3)
    for _ in range(20):
        counts = {rng.randint(1, 60): rng.randint(1, 500) for _ in range(rng.randint(1, 30))}
        entries, room = packing.plan(counts, 60), defaultdict(int)
        numbers = defaultdict(list)
        for length, first, bins, each, sequence, offset in entries:
            numbers[length].append((first, bins * each))
            for b in range(bins):
                room[sequence + b] += each * length
        for length, parts in numbers.items():  # every number once
            at = 0
            for first, n in sorted(parts):
                assert first == at
                at += n
            assert at == counts[length]
        assert max(room.values()) <= 60


def test_fullest_is_the_best_subset():
    rng = random.Random(8)
    for _ in range(200):
        counts, space = {rng.randint(1, 40): rng.randint(0, 3) for _ in range(6)}, rng.randint(0, 90)
        chosen = packing.fullest(counts, space)
        reach = {0}
        for n, c in counts.items():
            reach = {r + k * n for r in reach for k in range(c + 1)}
        assert sum(n * k for n, k in chosen) == max(r for r in reach if r <= space)
        assert all(k <= counts[n] for n, k in chosen)
