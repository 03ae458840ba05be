import itertools
import random

import pytest

from strandloom.functions import rearrange as R


def mk(bounds, novel=()):
    out = [dict(idx=i, lo=a, hi=b, novel=False) for i, (a, b) in enumerate(bounds)]
    for i, b in enumerate(out):
        b["gap_left"] = b["lo"] - out[i - 1]["hi"] if i else 0
        b["gap_right"] = out[i + 1]["lo"] - b["hi"] if i + 1 < len(out) else 0
        b.update(ll=b["lo"] - b["gap_left"], lh=b["lo"], rl=b["hi"], rh=b["hi"] + b["gap_right"])
    for n in novel:
        out.append(dict(idx=len(out), lo=0, hi=n, novel=True, gap_left=0, gap_right=0, ll=0, lh=0, rl=0, rh=0))
    return out


TEN = [(100 * i, 100 * i + 100) for i in range(10)]


SIZES = [130, 60, 230, 50, 330, 61, 140]  # seven blocks whose sizes add up differently in every set
SEVEN = [(sum(SIZES[:i]), sum(SIZES[:i + 1])) for i in range(7)]


def visits(*blocks):
    """Node path of block visits; a negative one is visited backwards, 7 is novel sequence."""
    return [x for b in blocks for x in ((2 * -b + 1, 2 * -b) if b < 0 else (2 * b, 2 * b + 1))]


@pytest.mark.parametrize("path,want", [
    (visits(0, 1, 4, 5, 6), ["DEL"]),
    (visits(0, 2, 3, 5, 6), ["DEL", "DEL"]),
    (visits(0, 1, 2, 3, 7, 4, 5, 6), ["INS"]),
    (visits(0, 1, 2, 3, -4, 5, 6), ["INV"]),
    (visits(0, 1, -4, -3, -2, 5, 6), ["INV"]),
    (visits(0, 1, 2, 1, 2, 3, 4, 5, 6), ["DUP:TANDEM"]),
    (visits(0, 1, 2, 3, 3, 3, 4, 5, 6), ["DUP:TANDEM"]),
    (visits(0, 7, 1, 2, 3, 4, 4, 5, 6), ["DUP:TANDEM", "INS"]),
    (visits(0, 1, 2, 3, 4, 5, 6), []),
])
def test_event_types(path, want):
    assert sorted(e["type"] for e in R.classify_haplotype(path, mk(SEVEN, [77]), 10)) == want


def test_event_fields():
    e = R.classify_haplotype(visits(0, 1, 2, 2, 2, 2, 3, 4), mk(SEVEN), 10)[0]
    assert (e["start"], e["end"], e["copynumber"], e["want"]) == (190, 420, 4, ["Dup"])
    e = R.classify_haplotype(visits(0, 1, 2, 5, 6), mk(SEVEN), 10)[0]
    assert (e["start"], e["end"], e["bp1_lo"], e["bp1_hi"]) == (420, 800, 419, 421)


@pytest.mark.parametrize("path,want", [
    (visits(0, 1, 2, 3, 4, 5, 6), set()),
    (visits(0, 1, 2, 3, 4, -5, 6), {5}),
    (visits(0, 3, 4, 5, 6), {1, 2}),
    (visits(0, 1, 2, 3, 7, 4, 5, 6), {7}),
    (visits(0, 1, 7, 2, 3, 5, 6), {4, 7}),
])
def test_affected_length(path, want):
    size = dict(enumerate(SIZES)) | {7: 77}
    assert R.affected_length(path, mk(SEVEN, [77])) == sum(size[b] for b in want)


def test_affected_length_of_published_call():
    # ABCDE -> ADCDE with B of 6 and D of 29 bases
    cuts = [134441, 135114, 135120, 136537, 136566, 138578]
    assert R.affected_length([0, 1, 6, 7, 4, 5, 6, 7, 8, 9], mk(list(zip(cuts, cuts[1:])))) == 35


def test_affected_length_against_all_alignments():
    """Union over every best alignment, found by exhaustive recursion."""
    rng = random.Random(4)
    for _ in range(20):
        n = rng.randrange(2, 4)
        blocks = mk([(10 ** i, 10 ** i * 2) for i in range(n)])
        visits = [(rng.randrange(n), rng.random() < .3) for _ in range(rng.randrange(1, 4))]
        path = [x for b, inv in visits for x in ((2 * b + 1, 2 * b) if inv else (2 * b, 2 * b + 1))]
        ref, alt = [(i, False) for i in range(n)] + [None], visits + [None]
        found = []

        def walk(i, j, score, hit):
            if i == len(ref) and j == len(alt):
                found.append((score, hit))
                return
            if i < len(ref) and j < len(alt):
                if ref[i] == alt[j]:
                    walk(i + 1, j + 1, score + 1000, hit)
                else:
                    walk(i + 1, j + 1, score - 1, hit | {x[0] for x in (ref[i], alt[j]) if x})
            if i < len(ref):
                walk(i + 1, j, score - 1, hit | ({ref[i][0]} if ref[i] else set()))
            if j < len(alt):
                walk(i, j + 1, score - 1, hit | ({alt[j][0]} if alt[j] else set()))
        walk(0, 0, 0, frozenset())
        best = max(s for s, _ in found)
        want = set().union(*[h for s, h in found if s == best])
        assert R.affected_length(path, blocks) == sum(blocks[b]["hi"] - blocks[b]["lo"] for b in want)


def test_simplify_collapses_untouched_runs():
    blocks, (path,) = R.simplify(mk(TEN), [[0, 1, 2, 3, 4, 5, 10, 11, 12, 13, 14, 15]])
    assert path == [0, 1, 4, 5] and [(b["lo"], b["hi"]) for b in blocks] == [(0, 300), (300, 500), (500, 800)]
    blocks, paths = R.simplify(mk(TEN), [[0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 2, 3, 4, 5]])
    assert paths == [[0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 2, 3, 4, 5]] and len(blocks) == 3


def test_diploid_genotypes():
    b = mk(TEN)
    ref, dele, inv = [0, 1, 2, 3, 4, 5, 6, 7], [0, 1, 2, 3, 6, 7], [0, 1, 2, 3, 5, 4, 6, 7]
    gt = lambda p, q: [(e["type"], e["genotype"]) for e in R.diploid_events(p, q, b, 10, "c", (0, 400))]
    assert gt(dele, dele) == [("DEL", "1/1")]
    assert gt(dele, ref) == [("DEL", "1/0")] and gt(ref, dele) == [("DEL", "0/1")]
    assert gt(dele, inv) == [("DEL", "1/0"), ("INV", "0/1")]


def test_haplotype_pieces():
    st, ins, left, right = R.haplotype_pieces([0, 1, 4, 5], mk([(0, 5000), (5000, 5100), (5100, 9000)]), 1000)
    assert st == [[(4000, 5000, False, 100), (5100, 6100, False, 0)]] and ins == [] and left and right


def test_equal_calls_are_described_once():
    import pyarrow as pa

    from strandloom.plans.classify import _each_once
    seen = []

    def fn(path, blocks):
        seen.append(path)
        return {"n": sum(path) + blocks[0]["lo"]}

    paths, blocks = [[0, 1], [2, 3], [0, 1], [0, 1], [4]], [[{"lo": x}] for x in (1, 2, 1, 1, 3)]
    made = pa.struct([("n", pa.int64())])
    call = lambda keys: _each_once(fn, pa.array(keys), [pa.array(paths), pa.array(blocks)], made).to_pylist()
    want = [{"n": n} for n in (2, 7, 2, 2, 7)]
    assert call([9, 8, 9, 9, 7]) == want and len(seen) == 3
    # different rows that share a hash
    assert call([9, 9, 9, 9, 7]) == want and len(seen) == 3 + 5
    assert _each_once(fn, pa.array([], pa.int64()), [pa.array([], pa.list_(pa.int64()))] * 2, made).to_pylist() == []
