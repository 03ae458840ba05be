"""Language ID, quality, extraction, vectors and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import extract, language, neighbours, quality

SMALL = "/root/testdata/sf0.001"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["été", "roi", "eau", "que"], "cc": ["sch", "ung", "über", "ein"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)) + "."


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 80)), lang, "x", 1.5) for i in range(400)]
    odd = [(400, None, "aa"), (401, "", "aa"), (402, "12 !? ½", "bb"), (403, prose(rng, "cc", 60000), "cc"), (404, rows[0][1], None),
           (None, rows[1][1], rows[1][2]), (405, "漢字仮名交じり文" * 20, None)]
    docs = spark.createDataFrame(rows + [(*o, "x", 1.5) for o in odd], "doc_id long, text string, lang string, rejected string, score double").repartition(3)
    got = language.identify(docs, language.held_out_by(5, 0), keep=("doc_id", "rejected", "score")).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in got)
    held = [(lang, by_id[i]["lang_pred"]) for i, _, lang, *_ in rows if by_id[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert not any(by_id[i]["rejected"] for i, *_ in rows)
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 and by_id[i]["rejected"] for i in (400, 401, 402))
    assert by_id[403]["lang_pred"] == "cc" and by_id[404]["lang_pred"] == rows[0][2] and by_id[405]["rejected"]
    assert got[0]["kept_rejected"] == "x" and got[0]["kept_score"] == 1.5
    nothing = language.identify(docs.withColumn("lang", F.lit(None).cast("string")), language.held_out_by(5, 0)).collect()
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in nothing)
    assert language.identify(docs.limit(0), language.held_out_by(5, 0)).count() == 0


def test_unlearned_languages_and_gibberish_are_rejected(spark):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    left_out = sorted(r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"])[0]
    junk = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(4000)]
    table = docs.withColumn("unlearned", F.col("lang") == left_out).withColumn("lang", F.when(F.col("lang") != left_out, F.col("lang"))).unionByName(
        spark.createDataFrame([(10**9 + i, " ".join(junk[40 * i:40 * i + 40]), None, None) for i in range(100)], "doc_id long, text string, lang string, unlearned boolean"))
    got = language.identify(table, language.held_out_by(5, 0), keep=("lang", "unlearned", "text")).where("length(kept_text) > 200").collect()

    def share(rows):
        return sum(r["rejected"] for r in rows) / len(rows)

    assert share([r for r in got if r["kept_unlearned"]]) > 0.9
    assert share([r for r in got if r["doc_id"] >= 10**9]) > 0.9
    assert share([r for r in got if r["kept_lang"] is not None and r["held_out"]]) < 0.02


def test_quality_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    # labels of a fifth of the documents are never seen
    seen = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    got = quality.classify(docs, seen).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got) > 0.93


def test_quality_takes_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, "aa", 40) if i % 2 else "!! ## " * 30, f"src{i % 7}", "aa", 100) for i in range(200)]
    rows += [(None, None, None, None, None), (500, "", "s", None, -3), (501, "x" * 300000, None, "aa", 2**40), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, kept string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, 0), (3, 1), (3, 1), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels, keep=("kept",)).collect()
    assert len(got) == len(rows) and all(0 <= r["quality_score"] <= 1 and r["kept_kept"] == "extra" for r in got)
    assert sum(r["kept"] == bool(r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] < 200) / 202 > 0.97
    unlabelled = quality.classify(docs, labels.where("quality = 1")).collect()
    assert all(r["quality_score"] == 0.5 and r["kept"] for r in unlabelled)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_views_teach_each_other(spark):
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 3000)
    views = [(truth[:, None] * 3 + rng.normal(size=(3000, 4))).astype(np.float32) for _ in range(2)]
    pool = spark.createDataFrame([tuple(bytearray(v[i].astype(np.float16).tobytes()) for v in views) for i in range(3000)], "text binary, meta binary").repartition(3)
    few, aside = np.arange(60), np.arange(60) % 5 == 0
    score = quality.cotrain(*[v[few] for v in views], truth[few], aside, pool).score(*views)
    assert ((score[:, 0] > 0.5) == truth).mean() > 0.95
    # the gradients are those of all rows at once
    betas = [np.linspace(-1, 1, 5), np.linspace(1, -1, 5)]
    for v, pull in enumerate(quality.pulls(pool, betas, betas)):
        x, other = (views[k].astype(np.float16).astype(np.float64) for k in (v, 1 - v))
        given = 1 / (1 + np.exp(-(other @ betas[1 - v][:-1] + betas[1 - v][-1])))
        sure = (given >= quality.CONFIDENT) | (given <= 1 - quality.CONFIDENT)
        miss = (given[sure] >= quality.CONFIDENT) - 1 / (1 + np.exp(-(x[sure] @ betas[v][:-1] + betas[v][-1])))
        assert np.allclose(pull, np.c_[x[sure], np.ones(sure.sum())].T @ miss / sure.sum(), atol=1e-4)


PARAGRAPH = "Rain came in from the west, slowly at first, and then, as the light went, it fell hard on the roofs of the town. "
PAGES = {
    "plain": (f"<html><head><title>t</title></head><body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>{PARAGRAPH}"
              f"<p>{PARAGRAPH * 2}</article><footer>&copy; 2020</footer></body></html>", ["Title & more", PARAGRAPH, PARAGRAPH * 2]),
    "divs": (f"<body><div id=menu><ul><li><a href=a>{'Item, one '* 9}</a><li><a href=b>Two</a></ul></div><div class='main-col'><h2>Head</h2><div class=body><p>{PARAGRAPH}</p>"
             f"<p>A <b>bold</b> &lt;tag&gt; and a&nbsp;&#8212; dash,\n\n broken <br>line that goes on for some time.</p></div><div class='share'>Share this</div></div>"
             f"<div class='sidebar'><p>{PARAGRAPH}</p></div><div id='comments'><p>{PARAGRAPH * 4}</p></div><script>var x = '<p>no</p>';</script></body>",
             ["Head", PARAGRAPH, "A bold <tag> and a — dash, broken line that goes on for some time."]),
    "notices": (f"<div class='cookie-notice'><p>We use cookies, and more, and more, and more.</p></div><main><p>{PARAGRAPH}</p><aside>{PARAGRAPH}</aside><form><p>{PARAGRAPH}</p></form>"
                f"<p style='display:none'>{PARAGRAPH}</p><ul><li>First point of it<li>Second point of it</ul></main>", [PARAGRAPH, "First point of it", "Second point of it"]),
    "cut": (f"<article><p>{PARAGRAPH}</p><p>Ends here<a href=\"http://", [PARAGRAPH, "Ends here"]),
    "inline": (f"<article><p><b>{PARAGRAPH}<br><p>{PARAGRAPH}</b></i></article>", [PARAGRAPH, PARAGRAPH]),
    "short": ("<body><nav>Menu</nav><article><h1>Hi</h1><p>Hi.</article></body>", ["Hi", "Hi."]),
    "bare": (PARAGRAPH, [PARAGRAPH]), "empty": ("", []), "null": (None, []), "noise": ("<<<>>> </p></div><p", ["<<<>>>"]),
    "comment": (f"<!-- <article> --><article><p>{PARAGRAPH}</p><!-- unclosed <p>hidden</p>", [PARAGRAPH]),
    "long": ("<article>" + f"<p>{PARAGRAPH}</p>" * 3000 + "</article>", [PARAGRAPH] * 3000),
    "deep": ("<div>" * 3000 + f"<p>{PARAGRAPH}</p>", [PARAGRAPH]),
}


@pytest.mark.parametrize("name", ["class='content has-sidebar'", "class='post with-sidebar'", "class='overflow-hidden'", "id=no-comments",
                                  "class='content-header'", "class='form-page'", "class='sidebar'", "id='widget'"])
def test_names_do_not_decide_alone(name):
    text = [PARAGRAPH.strip() + f" Part {i}." for i in range(6)]
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Entry number {i} of this long menu</a></li>" for i in range(20)) + "</ul>"
    page = f"<body><div class=top>{menu}</div><div {name}>{''.join(f'<p>{t}</p>' for t in text)}<div class='ad-slot'><p>{PARAGRAPH}</p></div></div></body>"
    assert extract.main_text(page) == "\n".join(text)


@pytest.mark.parametrize("name", """post-comments article-comments user-comments commentlist comment-thread comment-body responses discussion
    related-posts related-articles relatedPosts more-stories cookie-policy cookie-message ad_300x250 google-ads adsbygoogle promo-content author-bio
    comments-area ad-unit newsletter-box subscribe-form""".split())
@pytest.mark.parametrize("tag", ["article", "div"])
def test_parts_inside_the_text_go(name, tag):
    text = [PARAGRAPH.strip() + f" Part {i}." for i in range(6)]
    part = f"<div class='{name}'><p>{PARAGRAPH}</p><p>Another block of prose, as long as the others, that is no part of it.</p></div>"
    page = f"<body><{tag} class=post>{''.join(f'<p>{t}</p>' for t in text)}{part}</{tag}></body>"
    assert extract.main_text(page) == "\n".join(text)


@pytest.mark.parametrize("name", ["tag-cookies category-ads", "has-comments", "ad-free", "no-related", "topic-discussion", "load", "roadside", "commentary", "biology"])
def test_other_names_stay(name):
    text = [PARAGRAPH.strip() + f" Part {i}." for i in range(6)]
    page = f"<body><article><div class='{name}'>{''.join(f'<p>{t}</p>' for t in text)}</div><p>And one more.</p></article></body>"
    assert extract.main_text(page) == "\n".join([*text, "And one more."])


def test_boxes_of_links_go_and_linked_sentences_stay():
    box = "<ul>" + "".join(f"<li><a href=/{i}>Another story {i}</a></li>" for i in range(4)) + "</ul>"
    page = f"<article><p>{PARAGRAPH}</p>{box}<p>Read <a href=/x>the source</a> first, <a href=/y>then this</a>.</p><p><a href=/z>A linked sentence.</a></p><ol><li>One <a href=/o>thing</a> and more</li><li>two</li></ol></article>"
    assert extract.main_text(page) == "\n".join([PARAGRAPH.strip(), "Read the source first, then this.", "A linked sentence.", "One thing and more", "two"])


def test_extraction(spark):
    want = {k: "\n".join(" ".join(b.split()) for b in blocks) for k, (_, blocks) in PAGES.items()}
    rows = [(i, k, h, "clash") for i, (k, (h, _)) in enumerate(PAGES.items())]
    pages = spark.createDataFrame(rows + [(None, "plain", PAGES["plain"][0], ""), rows[1]], "page_id long, url string, html string, text string")
    got = extract.extract_pages(pages).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert r["text"] == want[r["url"]], r["url"]
        assert r["n_chars"] == len(r["text"])
    assert extract.extract_pages(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(60, 24))
    rows = [c + rng.normal(scale=s, size=24) for c, s in zip(centers, rng.uniform(0.05, 0.35, 60), strict=True) for _ in range(8)]
    rows += [centers[0] + rng.normal(scale=0.1, size=24) for _ in range(150)]  # more than any list holds
    rows += [centers[1] * 3] * 40 + list(rng.normal(size=(100, 24)))
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, [1.0, 2.0], [1.0, 2.1], [-1.0, 3.0]]
    return [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(rows)] + [(1000 + i, o) for i, o in enumerate(odd)] + [(None, [float(x) for x in np.float32(rows[3])]), (5, [float(x) for x in np.float32(rows[5])])]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_link_as_by_brute_force(spark, vectors, kind):
    usable = [bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in vectors]
    root, links = list(range(len(vectors))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(vectors):
        for j in range(i):
            b = vectors[j][1]
            if usable[i] and usable[j] and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links.update([i, j])
                root[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(vectors):
        if d is not None:
            lowest[find(i)] = min(d, lowest.get(find(i), d))
    want = Counter((d, links[i], lowest.get(find(i)), d is not None and lowest[find(i)] == d) for i, (d, _) in enumerate(vectors))
    table = spark.createDataFrame([(d, v, 3) for d, v in vectors], f"vec_id long, embedding array<{kind}>, node int").repartition(4)
    got = Counter(tuple(r) for r in neighbours.near_duplicates(table).collect())
    assert got == want
    assert neighbours.near_duplicates(table.limit(0)).count() == 0


def test_links_that_full_lists_have_no_room_for(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ATTEMPTS", 1)
    monkeypatch.setattr(neighbours, "AUDITED", 4)  # so that the audit does not mend it
    rng = np.random.default_rng(3)
    rows, of = [], []
    for pair in range(12):  # two tight groups of 30 each, 0.90 to 0.95 apart
        basis = np.linalg.qr(rng.normal(size=(48, 2)))[0].T
        for side in (-1, 1):
            center = np.cos(0.2) * basis[0] + side * np.sin(0.2) * basis[1]
            rows += [center + rng.normal(scale=0.006, size=48) for _ in range(30)]
            of += [2 * pair + (side > 0)] * 30
    x, of = np.array(rows), np.array(of)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    same, twin = of[:, None] == of[None, :], of[:, None] // 2 == of[None, :] // 2
    assert s[same].min() > 0.98 and 0.9 < s[twin & ~same].min() and s[twin & ~same].max() < 0.95 and s[~twin].max() < 0.9
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.near_duplicates(table).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(i, 59, i // 60 * 60) for i in range(len(x))}


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SMALL)
        assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
    kept = docs.count()
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.where("piece = 0").count() == kept and kept > 0.6 * 200
