"""Token counts, token alignment and manifests against the libraries and plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strandloom.llm import alignment, bytebpe, merkle
from strandloom.llm.tokens import byte_letters

ODD = [None, "", " ", "a ", "  \n\t x", "<|endoftext|>a <|endoftext|><|endoftext|>", "a" * 700, "日本語テスト" * 120, "\U0003d000՘x a", "a\x85b\x1c c",
       "İstanbul don't I'LL 'S a,'re,b x'", "é" * 501, " " * 333, "1234567" * 30, "▁a b", "   \t a\x00b   ", "<s>x</s> <unk> <0x41>", "🙂🙂 à ½ﬁ"]


def texts(n=150, seed=4):
    rng = random.Random(seed)
    words = ["the", "Rain", "éclair", "don't", "12,5", "!!", "über", "日本", "<|endoftext|>", "plain", "of", "\n\n", "  ", "xqzk" * 5]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(n)]
    wild = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x1FFFF), 32, 97]))
                    for _ in range(rng.randrange(50))) for _ in range(n)]
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ") for _ in range(120_000)) + " the rain" * 20_000
    return ODD + made + wild + [long] + made[:20]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 50 else None, t, "x", 1) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, pair long").repartition(5)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bytebpe.default_path())


def test_merging_equals_the_library(library):
    merges = bytebpe.Merges.of(bytebpe.default_path())
    assert merges.ordered
    for text in texts(seed=9):
        if text and "<|" not in text:
            words = [w for part in merges.split(text) for w in part]
            ids, start = merges.merged([w.encode() for w in words])
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
            assert len(start) == len(words) + 1


def test_one_occurrence_at_a_time_gives_the_same_tokens():
    merges = bytebpe.Merges(bytebpe.default_path())
    sequences = [t.encode() for t in ("banana" * 20, "aaaa" * 11, "the theme", "", "mississippi")]
    whole = merges.merged(sequences)
    merges.ordered = False
    assert all((a == b).all() for a, b in zip(whole, merges.merged(sequences), strict=True))


def test_counts_of_documents(docs, library, monkeypatch):
    rows = bytebpe.count_tokens(docs, limit=60).collect()
    given = Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids))
                    for r in docs.collect())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == given
    assert all(r["over_limit"] == (r["n_tokens"] > 60) for r in rows)


def test_a_full_memo_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMO_BYTES", 2000)
    merges = bytebpe.Merges(bytebpe.default_path())
    given = [t or "" for t in texts(seed=2)]
    assert merges.count(given).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in given]


def expected_alignment(given):
    a_lib = Tokenizer.from_file(bytebpe.default_path())
    a_lib.encode_special_tokens = True
    b_lib = SentencePieceProcessor(model_file=alignment.default_paths()[1])
    back = {c: b for b, c in byte_letters().items()}
    out, pairs = [], Counter()
    for text in given:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_raw = [bytes(back[c] for c in a_lib.id_to_token(i)) for i in a]
        b_raw = [bytes([int(b_lib.id_to_piece(i)[3:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            out.append(None)
            continue
        a_end, b_end = (dict(zip(np.cumsum([len(x) for x in raw]).tolist(), range(len(raw)), strict=True)) for raw in (a_raw, b_raw))
        both, i, j, groups = sorted(set(a_end) & set(b_end)), 0, 0, []
        for e in both:
            groups.append((a[i:a_end[e] + 1], b[j:b_end[e] + 1]))
            i, j = a_end[e] + 1, b_end[e] + 1
        links = [(a[a_end[e]], b[b_end[e]]) for e in both]
        pairs.update(links)
        a_at, b_at = ([k for k, x in enumerate(raw) for _ in x] for raw in (a_raw, b_raw))
        out.append((len(a), len(b), groups, links, len(set(zip(a_at, b_at, strict=True)))))
    return out, pairs


@pytest.mark.parametrize("frequent", [1 << 18, 300, 0])
def test_alignment_equals_the_plain_one(docs, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "TERMS", 1000)
    monkeypatch.setattr(alignment, "TOGETHER", 3000)
    given = docs.collect()
    wanted, pairs = expected_alignment([r["text"] for r in given])
    most = Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    expected = Counter()
    for r, w in zip(given, wanted, strict=True):
        if w is None:
            expected[(r["doc_id"], 0, 0, 0, 0, 0, 0, "", 0, 0)] += 1
            continue
        n_a, n_b, groups, links, overlaps = w
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        expected[(r["doc_id"], n_a, n_b, len(groups), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links),
                  hashlib.sha256(text.encode()).hexdigest(), overlaps, sum(len(a) * len(b) for a, b in groups))] += 1
    assert Counter(map(tuple, alignment.align_documents(docs).collect())) == expected


def test_products_of_rows():
    rng = np.random.default_rng(3)
    x, y = (rng.integers(0, 3, (9, 13)) * (rng.random((9, 13)) < 0.3), rng.integers(0, 3, (13, 7)) * (rng.random((13, 7)) < 0.4))

    def sparse(m):
        row, column = np.nonzero(m)
        return alignment.Csr(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(m)))]), column, m[row, column], m.shape[1])

    def dense(m):
        out = np.zeros((len(m.start) - 1, m.width), np.int64)
        out[alignment.pairs(m)] = m.value
        return out

    assert (dense(alignment.product(sparse(x), sparse(y))) == x @ y).all()
    assert (dense(alignment.transposed(sparse(x))) == x.T).all()
    a, b = np.array([2, 3, 7]), np.array([1, 3, 5, 7])
    assert dense(alignment.overlap_links(a, b)).tolist() == [[1, 1, 0, 0], [0, 1, 0, 0], [0, 0, 2, 2]]
    assert dense(alignment.shared_group_links(a, b, np.array([3, 7]))).tolist() == [[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 1]]


def plain_manifest(rows, arity):
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r, text):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def siblings(levels, i):
        for level in levels[:-1]:
            at = i // arity * arity
            yield level[at:i], level[i + 1:at + arity]
            i //= arity

    def order(r):
        return (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))

    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by_source = {s: sorted((r for r in rows if r["source"] == s), key=order) for s in sources}
    trees = {s: tree([leaf(r, r["text"]) for r in by_source[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for i, r in enumerate(by_source[s]):
            path, text = [*siblings(trees[s], i), *siblings(top, k)], r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            root = leaf(r, text)
            for before, after in path:
                root = h(*before, root, *after)
            yield (r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], h(*(x for b, a in path for x in b + a)), root, root == top[-1][0])


@pytest.mark.parametrize(("arity", "n"), [(16, 700), (2, 40), (3, 60), (16, 1)])
def test_manifest_equals_the_plain_one(spark, arity, n):
    rng = random.Random(n)
    names = [None, "", "a", "b", "ä", "=", "B"] + ["hot"] * 12 + [f"s{k}" for k in range(20)]
    rows = [(k if k % 30 else None, rng.choice([None, "", "Plain Text", "lower", "ÄB ß", "X" * 5000]), rng.choice([None, "en"]), rng.choice(names),
             rng.choice([None, 3])) for k in range(n)]
    docs = spark.createDataFrame(rows + rows[:n // 20], "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {"tree": F.lit(1), "idx": F.lit(2), "path": F.lit(3)})
    out = merkle.manifest(docs, merkle.crc_divisible("doc_id", 5), arity).drop("source", "idx")
    assert Counter(map(tuple, out.collect())) == Counter(plain_manifest(docs.collect(), arity))


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.manifest(none).count() == 0
    assert alignment.align_documents(none).count() == 0
    assert bytebpe.count_tokens(none).count() == 0
