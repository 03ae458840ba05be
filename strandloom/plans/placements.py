"""Where on a candidate path reads can start and be mapped, and how likely its read pairs are seen.

A path is a row of pieces: sequence of the reference, novel sequence, assembly gaps.  A read that
starts at some position is in one of three states:

* ``INSIDE``: it lies in novel sequence, so that no run of ``m`` other bases is within it,
* ``GAP``: it holds such runs, but none of them touches reference sequence,
* ``SEEN``: it can be mapped.

The states are constant between few positions, so each read length has a short table of
stretches.  A path's constant is the mass of all pairs of starts, each pair of stretches weighted
by the chance that such a pair gives an observation.
"""

from __future__ import annotations

import numpy as np

SEEN, INSIDE, GAP = 0, 1, 2


def laid_out(lens, gaps_in, gaps_out, novel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and kind (True for novel, False for reference) of the blocks of a path, and its length, with the gaps between.

    Between two blocks lies half of the gaps that they face, at each end of the path a whole gap.
    """
    lens, novel = np.asarray(lens, np.int64), np.asarray(novel, bool)
    before, after = np.asarray(gaps_in, np.int64), np.asarray(gaps_out, np.int64)
    space = np.concatenate([before[:1], (after[:-1] + before[1:]) // 2, after[-1:]])
    end = np.cumsum(space[:-1] + lens)
    return np.stack([end - lens, end]), novel, end[-1] + space[-1]


def novel_stretches(blocks: np.ndarray, novel: np.ndarray, read: int, m: int) -> np.ndarray:
    """First and last start of the reads that lie in novel sequence, one row for each stretch.

    Novel blocks with fewer than ``m`` bases between them act as one; what is before the first
    and after the last one goes on outside the path.
    """
    start, end = blocks[:, novel]
    if not len(start):
        return np.empty((0, 2), np.int64)
    apart = np.flatnonzero(start[1:] - end[:-1] >= m)
    first, last = start[np.r_[0, apart + 1]], end[np.r_[apart, len(end) - 1]]
    out = np.stack([first - m + 1, last + m - read - 1], axis=1)
    return out[out[:, 0] <= out[:, 1]]


def _held(start: np.ndarray, end: np.ndarray, read: int, m: int) -> np.ndarray:
    """Read starts that hold one of the runs of ``m`` bases whose first base is from start to end."""
    some = start <= end
    return np.stack([start[some] - (read - m), end[some]], axis=1)


def stretches(blocks: np.ndarray, novel: np.ndarray, length: int, read: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and state of the stretches that cover the whole path."""
    # other sequence in one piece: what novel blocks leave
    run_start, run_end = np.r_[0, blocks[1, novel]], np.r_[blocks[0, novel], length]
    ref_start, ref_end = blocks[:, ~novel]
    home = np.searchsorted(run_start, ref_start, "right") - 1
    tables = [novel_stretches(blocks, novel, read, m), _held(run_start, run_end - m, read, m),
              _held(np.maximum(run_start[home], ref_start - m + 1), np.minimum(run_end[home] - m, ref_end - 1), read, m)]
    tables = [np.clip(t, [0, -1], [length, length - 1]) for t in tables]
    cut = np.unique(np.concatenate([[0, length], *(np.r_[t[:, 0], t[:, 1] + 1] for t in tables)]))
    cut = cut[(cut >= 0) & (cut <= length)]
    at = cut[:-1]
    inside, held, touching = (((t[:, :1] <= at) & (at <= t[:, 1:])).any(axis=0) for t in tables)
    return at, cut[1:] - 1, np.where(inside, INSIDE, np.where(held & ~touching, GAP, SEEN))


def pair_mass(sums: np.ndarray, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mass of a distance distribution over all pairs of stretches of x (rows) and y (columns), from its double prefix sums."""
    sums = np.asarray(sums, float)

    def upto(d: np.ndarray) -> np.ndarray:
        beyond = d - (len(sums) - 1)  # past the table the single sum is one
        return np.where(d < 0, 0.0, sums[np.clip(d, 0, len(sums) - 1)] + np.maximum(beyond, 0))

    (a, b), (c, d) = (np.asarray(v)[:, None] for v in x), (np.asarray(v)[None, :] for v in y)
    return upto(d - a + 1) - upto(d - b) - upto(c - a) + upto(c - b - 1)


def constant(lens, gaps_in, gaps_out, novel, sums, chances, first_read: int, second_read: int, m: int) -> float:
    """Chance that a pair placed on the path is observed, summed over all placements."""
    blocks, is_novel, length = laid_out(lens, gaps_in, gaps_out, novel)
    if length <= 0:
        return 0.0
    one = chances[0] + chances[1] + chances[3]  # seen although the other end is inside novel sequence
    weight = np.array([[1.0, one, 0.0], [one, 0.0, 0.0], [0.0, 0.0, 0.0]])
    *x, x_state = stretches(blocks, is_novel, length, first_read, m)
    *y, y_state = stretches(blocks, is_novel, length, second_read, m)
    return float((weight[x_state[:, None], y_state[None, :]] * pair_mass(sums, x, y)).sum())
