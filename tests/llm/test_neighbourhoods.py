"""Neighbourhoods of one size are compared together, with what each gives on its own."""

import numpy as np
import pyarrow as pa

from strandloom.llm import neighbours as N


def test_unit_of_single_and_double_bytes():
    rng = np.random.default_rng(1)
    rows = [rng.standard_normal(5).astype(kind) for kind in (np.float32, np.float64, np.float64, np.float32)]
    want = np.stack([r.astype(float) / np.linalg.norm(r.astype(float)) for r in rows])
    for mine in ([0, 1, 2, 3], [0, 3], [1, 2]):
        assert np.allclose(N.unit([rows[i].tobytes() for i in mine], 5), want[mine], atol=1e-12)


def test_groups_compared_together_equal_those_alone():
    rng = np.random.default_rng(2)
    centers, vectors = [], []
    for center, (size, dim) in enumerate([(3, 4), (1, 4), (3, 7), (2, 4), (3, 4), (9, 7), (2, 7), (3, 4), (1, 7)]):
        centers += [center] * size
        vectors += list(rng.standard_normal((size, dim)))
    n = len(centers)
    end = [None if k % 3 else k / n for k in range(n)]
    table = pa.table({"center": pa.array(centers, pa.int64()), "member": pa.array(range(n), pa.int64()), "v": pa.array([v.tobytes() for v in vectors], pa.binary()),
                      "dim": pa.array([len(v) for v in vectors], pa.int32()), "end": pa.array(end, pa.float64())})
    for rows in (2, 5, n):
        found, calls = {}, 0
        for s, ids, ends in N.compared(iter(table.to_batches(max_chunksize=rows)), "member", "end"):
            calls += 1
            for one, members, e in zip(s, ids, ends, strict=True):
                found[tuple(members.tolist())] = one
                assert all(np.isnan(x) if end[m] is None else x == end[m] for m, x in zip(members, e, strict=True))
        assert sorted(m for group in found for m in group) == list(range(n))
        for members, s in found.items():
            assert len({centers[m] for m in members}) == 1 and centers.count(centers[members[0]]) == len(members)
            x = np.stack([vectors[m] / np.linalg.norm(vectors[m]) for m in members])
            assert np.allclose(s, x @ x.T, atol=1e-12)
    assert calls == 7 and not list(N.compared(iter([]), "member"))  # of nine groups, by size and length
