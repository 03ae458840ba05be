"""Similarity join, language-model scores, fingerprints and shards against brute force, on texts with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import brown, fingerprints, jaccard, language, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, th string, n int, key int"


def words(text):
    return WORD.findall((text or "").encode().lower().decode())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, texts = prose(70), []
    for n in (3, 4, 5, 6, 7, 8, 9, 12, 20, 60, 200):  # small and large sets, each with nearby variants
        base = prose(n)
        for edits in (0, 0, 1, 1, 2, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(base + prose(max(1, n // 8))))
    template = prose(120)
    for _ in range(60):  # a large group of near copies, and many texts around one passage
        copy = list(template)
        copy[rng.randrange(120)] = rng.choice(vocabulary)
        texts += [" ".join(copy), " ".join(prose(rng.randint(1, 60)) + passage)]
    chain = prose(100)
    for _ in range(8):  # neighbours are similar, ends are not
        chain = chain[6:] + prose(6)
        texts.append(" ".join(chain))
    texts += [None, "", " \n\t", "one", "ONE", "one two", "One  two\n", "x" * 5000, "Éa é\x0bb\x1cc d e f", " ".join(["again"] * 400), " ".join(prose(9000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (2, texts[2]), (2, "other text under a known id"), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in corpus], SCHEMA).repartition(5).cache()


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def groups(corpus):
    sets = [shingles(t) for _, t in corpus]
    return sets, components(sets)


def test_join_finds_all_groups(docs, corpus, groups):
    sets, root = groups
    lowest = {}
    for (d, _), r in zip(corpus, root, strict=True):
        if d is not None:
            lowest[r] = min(d, lowest.get(r, d))
    want = Counter((d, len(s), d if not s else lowest.get(r)) for (d, _), s, r in zip(corpus, sets, root, strict=True))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_sets(docs).collect())
    assert got == want
    assert max(Counter(root).values()) > 50  # the near copies are one group


@pytest.mark.parametrize("light", [3, 40, 300])
def test_join_with_any_boundary(docs, corpus, groups, light, monkeypatch):
    """Light and heavy sets must agree wherever the boundary is."""
    monkeypatch.setattr(jaccard, "boundary", lambda sets: light)
    sets, root = groups
    got = jaccard.join_sets(docs).where("component is not null").select("component").distinct().count()
    assert got == len({r for s, r in zip(sets, root, strict=True) if s})


def test_deduplication_keeps_one_of_each_group(docs, corpus, groups):
    sets, root = groups
    kept = jaccard.deduplicated(docs).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "th", "n", "key"}
    empty = sum(not s for s in sets)
    assert len(kept) == empty + len({r for s, r in zip(sets, root, strict=True) if s})
    assert jaccard.deduplicated(docs.limit(0)).count() == 0


def test_scores_agree_with_counts(docs, corpus):
    rows = brown.score(docs, language.held_out_by(7, 2)).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    training = [words(t) for d, t in corpus if not held(d)]
    count, ends = Counter(w for t in training for w in t), len(training)
    n, v = sum(count.values()) + ends, len(count) + 1

    def base(t):
        return sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)) + math.log10((ends + 1) / (n + v + 1))

    want = sorted((str(d), held(d), len(words(t)) + 1, sum(count[w] > 0 for w in words(t)) + 1, n, round(base(t), 5)) for d, t in corpus)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-3 for g, w in zip(got, want, strict=True))
    assert sum(r["score"] for r in rows if not r["held_out"]) > sum(r["base_score"] for r in rows if not r["held_out"])
    assert brown.score(docs.limit(0), language.held_out_by(7, 2)).count() == 0


def test_words_beyond_the_known_ones_are_joined(docs, monkeypatch):
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4), round(r["score"], 4))
    want = sorted(map(key, brown.score(docs, language.held_out_by(7, 2)).collect()))
    monkeypatch.setattr(brown, "KNOWN", 20)
    lexicon_limited = sorted(map(key, brown.score(docs, language.held_out_by(7, 2)).collect()))
    assert [w[:4] for w in want] == [g[:4] for g in lexicon_limited]


def plain_model(training, classes, shapes, known):
    """log10 of a text by a class model that is written out: ``classes`` of known words and of shapes."""
    count, ends = Counter(w for t in training for w in t), len(training)
    size, total = Counter({s: 0 for s in range(brown.SHAPES)}), Counter({s: 1 for s in range(brown.SHAPES)})
    for w, c in count.items():
        if w not in known:
            size[shapes[w]] += c
            total[shapes[w]] += c + 1
    cls = lambda w: classes[w] if w in known else classes[shapes[w]]
    end, k = brown.CLASSES - 1, brown.CLASSES
    follow, into = Counter(), Counter()
    for t in training:
        path = [end, *map(cls, t), end]
        follow.update(zip(path, path[1:]))
    for (_, b), n in follow.items():
        into[b] += n
    out_of, tokens = Counter(), sum(follow.values())
    for (a, _), n in follow.items():
        out_of[a] += n
    inside = Counter({end: ends + brown.ADD})
    for w in known:
        inside[classes[w]] += count[w] + brown.ADD
    for s in range(brown.SHAPES):
        inside[classes[s]] += size[s] + brown.ADD

    def log_p(t):
        path, out = [end, *map(cls, t), end], 0.0
        for a, b in zip(path, path[1:]):
            out += math.log10((follow[a, b] + brown.PRIOR * (into[b] + 1) / (tokens + k)) / (out_of[a] + brown.PRIOR))
        for w in t:
            if w in known:
                out += math.log10((count[w] + brown.ADD) / inside[classes[w]])
            else:
                out += math.log10((size[shapes[w]] + brown.ADD) / inside[classes[shapes[w]]]) + math.log10((count[w] + 1) / total[shapes[w]])
        return out + math.log10((ends + brown.ADD) / inside[end])

    return log_p


@pytest.mark.parametrize("most", [1 << 18, 12])
def test_scores_equal_a_plain_model(docs, corpus, monkeypatch, most):
    monkeypatch.setattr(brown, "KNOWN", most)
    monkeypatch.setattr(brown, "UNIT_WORDS", 5)
    monkeypatch.setattr(brown, "UNITS", 5 + brown.SHAPES + 1)
    monkeypatch.setattr(brown, "END", 5 + brown.SHAPES)
    models = []
    keep = brown.model_of
    monkeypatch.setattr(brown, "model_of", lambda *a: models.append(keep(*a)) or models[-1])
    rows = brown.score(docs, language.held_out_by(7, 2)).collect()
    model = models[0]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    every = sorted({w for _, t in corpus for w in words(t)})
    (_, _, hashes, shape, _), = brown.tokens(pa.array([" ".join(every)]))
    place, found = model.lexicon.look_up(hashes)
    known = {w for w, p, f in zip(every, place, found) if f and model.classes[p] >= 0}
    assert sum(found) <= most and 0 < len(known) < len(every)
    classes = {w: int(model.classes[p]) for w, p in zip(every, place) if w in known} | {s: int(model.of[s]) for s in range(brown.SHAPES)}
    log_p = plain_model([words(t) for d, t in corpus if not held(d)], classes, dict(zip(every, shape.tolist())), known)
    want = Counter((str(d), round(log_p(words(t)), 4)) for d, t in corpus)
    got = Counter((str(r["doc_id"]), round(r["score"], 4)) for r in rows)
    assert all(any(abs(g - w) < 1e-3 for e, w in want if e == d) for d, g in got) and sum(got.values()) == sum(want.values())
    # words of a class, shapes and the end share its mass
    mass = np.bincount(model.of, 10 ** model.emit_shape, brown.CLASSES) + np.bincount(model.classes[model.classes >= 0], 10 ** model.emit[model.classes >= 0], brown.CLASSES)
    assert np.allclose(mass[mass > 0], 1) and np.allclose((10 ** model.step).sum(axis=1), 1)


def test_words_go_to_the_class_of_their_contexts():
    rng = np.random.default_rng(1)
    step = brown.transitions(rng.integers(0, 50, (brown.CLASSES, brown.CLASSES)).astype(float))
    size, truth = np.full(brown.CLASSES, 100.0), rng.integers(0, brown.CLASSES - 1, 30)
    n = np.concatenate([rng.multinomial(3000, step[:, c] / step[:, c].sum()) for c in truth]).reshape(30, -1)
    m = np.stack([rng.multinomial(3000, step[c]) for c in truth])
    assert (brown.best_class(np.hstack([n, m]).astype(float), step, size) == truth).mean() > 0.9


def test_exchange_only_raises_the_likelihood():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 3, 40)
    pairs = rng.poisson(np.array([[9, 1, 1], [1, 1, 9], [1, 9, 1]])[truth][:, truth]).astype(float)

    def likelihood(of):
        m = np.eye(8)[of].T @ pairs @ np.eye(8)[of]
        return brown._phi(m).sum() - brown._phi(m.sum(axis=0)).sum() - brown._phi(m.sum(axis=1)).sum()

    steps = [likelihood(brown.exchange(pairs, 8, rounds)) for rounds in range(4)]
    assert steps == sorted(steps) and steps[-1] > steps[0]


def test_fingerprints_agree_with_whole_texts(docs, corpus):
    rows = fingerprints.fingerprint_documents(docs).collect()
    assert len(rows) == len(corpus)
    by_id = {r["doc_id"]: r for r in rows}
    counts = Counter(d for d, _ in corpus)
    order = sorted((d for d in counts if d is not None), reverse=True)
    text = dict(corpus)
    for d, after in zip(order, order[1:]):
        if counts[d] > 1 or counts[after] > 1:
            continue
        a, b, r = text[d] or "", text[after] or "", by_id[d]
        k = len(a) // 3
        new = fingerprints.Prefixes(a[:len(a) - k] + b[:k])
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(new.text.encode()).hexdigest()
        assert r["edited_fingerprint"] == fingerprints.written(new.n, new.whole(), fingerprints.smallest(new.windows()))
        assert r["common_prefix_next"] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = {}
    for r in rows:
        if counts[r["doc_id"]] == 1:
            assert same.setdefault(text[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    assert len(set(same.values())) == len(same)
    alone = fingerprints.fingerprint_documents(docs.where("doc_id = 9")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0


def test_spans_and_extensions():
    rng = random.Random(4)
    text = "".join(rng.choices("abé🙂", k=400))
    text += text[30:200] + "!" + text[:50]
    a = fingerprints.Prefixes(text)
    for _ in range(300):
        i, j, n = rng.randrange(300), rng.randrange(300), rng.randrange(1, 12)
        assert (a.span(i, i + n) == a.span(j, j + n)) == (text[i:i + n] == text[j:j + n])
        longest = next((k for k in range(len(text)) if j + k >= len(text) or i + k >= len(text) or text[i + k] != text[j + k]), 0)
        assert fingerprints.common_extension(a, i, a, j) == (longest if i != j else len(text) - i)


def test_shards_follow_the_order_of_keys(docs, corpus):
    rows = sharding.shard_by_size(docs, shards=16).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in corpus)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for shard, members in by_shard.items():
        assert 0 <= shard < 16 and sorted(r["slot"] for r in members) == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / 16) <= 2 * largest
    assert sharding.shard_by_size(docs.limit(0)).count() == 0


def test_a_hot_text_is_split_over_shards(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('same ', 40) ELSE concat('text ', repeat(cast(id AS string), 30)) END AS text")
    rows = sharding.shard_by_size(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    assert len({(r["shard"], r["slot"]) for r in rows}) == 6000
