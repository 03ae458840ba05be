"""Small per-call helpers on block paths: simplification, event typing, affected length.

A call holds a handful of blocks, so these are plain functions applied inside an
Arrow-batched UDF; everything before and after them is relational.

A block is a dict with idx, lo, hi, gap_left, gap_right, novel and its bordering breakpoint
intervals ll, lh, rl, rh.
"""

from __future__ import annotations

from collections import Counter


def visits_of(path):
    """(block, inverted) of every traversal."""
    return [(path[i] // 2, path[i] % 2 == 1) for i in range(0, len(path), 2)]


def simplify(blocks, paths):
    """Merge runs of reference blocks that every path passes together.

    Returns (new blocks, new paths).  Blocks b and b+1 merge when each visit of b's right side
    continues to b+1's left side and the reverse; sides no path visits agree with anything.
    """
    after: dict[int, set] = {}
    for path in paths:
        after.setdefault(path[0], set()).add(None)
        after.setdefault(path[-1], set()).add(None)
        for i in range(1, len(path) - 1, 2):
            after.setdefault(path[i], set()).add(path[i + 1])
            after.setdefault(path[i + 1], set()).add(path[i])
    seen = [b for path in paths for b, _ in visits_of(path)]
    genome = [b for b in seen if not blocks[b]["novel"]]
    top = max(genome)
    fresh, node_map, open_lo = [], {}, None
    for b in range(min(genome), top + 1):
        open_lo = blocks[b]["lo"] if open_lo is None else open_lo
        right = 2 * b + 1
        glued = b < top and after.get(right, set()) <= {right + 1} and after.get(right + 1, set()) <= {right}
        if not glued:
            node_map[2 * b], node_map[right] = 2 * len(fresh), 2 * len(fresh) + 1
            fresh.append(dict(lo=open_lo, hi=blocks[b]["hi"], novel=False))
            open_lo = None
    for b in seen:
        if blocks[b]["novel"]:
            node_map[2 * b], node_map[2 * b + 1] = 2 * len(fresh), 2 * len(fresh) + 1
            fresh.append(dict(lo=blocks[b]["lo"], hi=blocks[b]["hi"], novel=True))
    # a merged run keeps one entry and one exit, carried by its last block
    return fresh, [[node_map[n] for n in path if n in node_map] for path in paths]


def side_gap(blocks, node):
    """Distance from one side of a block to its neighbour in a block list; 0 at ends and novel blocks."""
    b = node // 2
    if blocks[b]["novel"]:
        return 0
    if node % 2:
        nxt = b + 1 < len(blocks) and not blocks[b + 1]["novel"]
        return blocks[b + 1]["lo"] - blocks[b]["hi"] if nxt else 0
    return blocks[b]["lo"] - blocks[b - 1]["hi"] if b > 0 else 0


def with_flanks(blocks, path, flank):
    """Simplified haplotype with its outer blocks trimmed to ``flank`` bases.

    Only an outermost reference block that is traversed once, forwards, is trimmed.
    """
    blocks, (path,) = simplify(blocks, [path])
    seq = [b for b, _ in visits_of(path)]
    counts, genome = Counter(seq), [b for b in seq if not blocks[b]["novel"]]
    first, last = seq[0], seq[-1]
    left = first == min(genome) and path[0] % 2 == 0 and counts[first] == 1
    right = last == max(genome) and path[-1] % 2 == 1 and counts[last] == 1
    if left:
        blocks[first]["lo"] = max(blocks[first]["lo"], blocks[first]["hi"] - flank)
    if right:
        blocks[last]["hi"] = min(blocks[last]["hi"], blocks[last]["lo"] + flank)
    return blocks, path, left, right


def bp_interval(block, side):
    """Open breakpoint interval at the '+' (left) or '-' (right) side of a block."""
    if side == "+":
        return block["lo"] - block["gap_left"] - 1, block["lo"] + 1
    return block["hi"] - 1, block["hi"] + block["gap_right"] + 1


def _edge(block, left):
    return (block["ll"], block["lh"]) if left else (block["rl"], block["rh"])


# fixed values: discordant class expected at a breakend pair, by orientation in coordinate order
BREAKEND_CLASS = {("-", "+"): "Del", ("+", "-"): "Dup", ("-", "-"): "InvL", ("+", "+"): "InvR"}


def novel_junctions(visits, n_genome):
    """Indices k where visit k does not continue to visit k+1 as in the reference."""
    out = []
    for k in range(len(visits) - 1):
        (a, ia), (b, ib) = visits[k], visits[k + 1]
        follows = ia == ib and b == (a - 1 if ib else a + 1)
        if not (follows and a < n_genome and b < n_genome):
            out.append(k)
    return out


def _event(kind, lo=None, hi=None, length=None, copies=None, bp1=None, bp2=None, ends=None, want=(), **more):
    a, b = ends or (None, None)
    return dict(type=kind, start=lo, end=hi, length=length, copynumber=copies,
                bp1_lo=bp1[0], bp1_hi=bp1[1], bp2_lo=bp2[0], bp2_hi=bp2[1],
                a_lo=a and a[0], a_hi=a and a[1], b_lo=b and b[0], b_hi=b and b[1], want=list(want),
                **{"orient1": None, "orient2": None, "bnd_ins": 0, "gap": None, **more})


def classify_haplotype(path, blocks, n_genome):
    """Events of one haplotype from left to right: DEL, INS, INV, DUP:TANDEM, else BND.

    Each rule looks at the next novel junction and reports how many junctions it explains.
    """
    visits = visits_of(path)
    counts = Counter(b for b, _ in visits)
    plain = lambda k: 0 <= k < len(visits) and not visits[k][1] and counts[visits[k][0]] == 1
    forward_run = lambda i, j, a, b: (visits[i:j] == [(x, False) for x in range(a, b + 1)])

    def deletion(k):
        a, b = visits[k][0], visits[k + 1][0]
        if plain(k) and plain(k + 1) and a + 1 < b and all(counts[x] == 0 for x in range(a + 1, b)):
            lo, hi = blocks[a]["hi"], blocks[b - 1]["hi"]
            return 1, _event("DEL", lo, hi, hi - lo, 0, bp_interval(blocks[a], "-"), bp_interval(blocks[b], "+"),
                             (_edge(blocks[a], False), _edge(blocks[b], True)), ["Del"])

    def insertion(k):
        if k + 2 < len(visits) and plain(k) and plain(k + 2) and visits[k + 2][0] == visits[k][0] + 1 \
                and blocks[visits[k + 1][0]]["novel"]:
            a, size = blocks[visits[k][0]], blocks[visits[k + 1][0]]
            size = size["hi"] - size["lo"]
            bp = bp_interval(a, "-")
            return 2, _event("INS", a["hi"], a["hi"] + size, size, 1, bp, bp, (_edge(a, False), None), ["Ins"])

    def inversion(k):
        j = k + 1
        while j < len(visits) and visits[j][1]:
            j += 1
        if j == k + 1 or j == len(visits) or not (plain(k) and counts[visits[j][0]] == 1):
            return None
        a, z = visits[k][0], visits[j][0]
        if [b for b, _ in visits[k + 1:j]] == list(range(z - 1, a, -1)):
            lo, hi = blocks[a]["hi"], blocks[z - 1]["hi"]
            return 2, _event("INV", lo, hi, hi - lo, 1, bp_interval(blocks[a], "-"), bp_interval(blocks[z - 1], "-"),
                             (_edge(blocks[a], False), _edge(blocks[z], True)), ["InvL", "InvR"])

    def tandem(k):
        first, last = visits[k + 1][0], visits[k][0]
        times = counts[first]
        if times < 2:
            return None
        # latest earlier visit of the repeat's first block; the very first visit counts only for k == 0
        starts = [i for i in range(k, 0, -1) if visits[i][0] == first] or ([0] if k == 0 and visits[0][0] == first else [])
        if not starts:
            return None
        s = starts[0]
        size, stop = k - s + 1, s + times * (k - s + 1)
        run = visits[s:stop]
        if run != [(b, False) for b in range(first, last + 1)] * times or len(run) != size * times:
            return None
        if s > 0 and not (plain(s - 1) and visits[s - 1][0] == first - 1):
            return None
        if stop < len(visits) and not (plain(stop) and visits[stop][0] == last + 1):
            return None
        lo = blocks[visits[s - 1][0]]["hi"] if s > 0 else blocks[first]["lo"]
        hi = blocks[last]["hi"]
        bp2 = bp_interval(blocks[last], "-")
        widths = [bp_interval(blocks[x], "+") for x in range(first, last)] + [bp2]
        return times - 1, _event("DUP:TANDEM", lo, hi, hi - lo, times, bp_interval(blocks[first], "+"), bp2,
                                 (_edge(blocks[first], True), _edge(blocks[last], False)), ["Dup"],
                                 gap=sum(b - a - 2 for a, b in widths))

    def breakend(k):
        (a, ia), (b, ib) = visits[k], visits[k + 1]
        novel = blocks[b]["novel"]
        size = blocks[b]["hi"] - blocks[b]["lo"] if novel else 0
        if novel:
            b, ib = visits[k + 2]
        sides = ("+" if ia else "-", "-" if ib else "+")
        bp1, bp2 = bp_interval(blocks[a], sides[0]), bp_interval(blocks[b], sides[1])
        ordered = sides[::-1] if bp1[1] > bp2[0] and bp2[1] <= bp1[0] else sides
        ends = None if novel else (_edge(blocks[a], ia), _edge(blocks[b], not ib))
        return (2 if novel else 1), _event("BND", bp1=bp1, bp2=bp2, ends=ends,
                                           want=[] if novel else [BREAKEND_CLASS[ordered]],
                                           orient1=sides[0], orient2=sides[1], bnd_ins=size)

    events, at, junctions = [], 0, novel_junctions(visits, n_genome)
    while at < len(junctions):
        for rule in (deletion, insertion, inversion, tandem, breakend):
            hit = rule(junctions[at])
            if hit:
                events.append(hit[1])
                at += max(1, hit[0])
                break
    return events


def same_variant(a, b):
    """Type, extent, copy number and first breakpoint agree."""
    keys = ("type", "start", "end", "copynumber", "bp1_lo", "bp1_hi")
    return all(a[k] == b[k] for k in keys)


def diploid_events(path1, path2, blocks, n_genome, chrom, span):
    """Events of both haplotypes with genotype and event id; shared simple events appear once."""
    one, two = (classify_haplotype(p, blocks, n_genome) for p in (path1, path2))
    hom = path1 == path2
    compound = not hom and bool(one) and bool(two)
    out = []
    letter = 0
    for own, other, gt in ((one, two, "1/0"), (two, one, "0/1")):
        if not own or (own is two and hom):
            continue
        letter += 1
        # beyond 26 events a number replaces the letter
        tag = ("" if not compound else chr(64 + letter)) if letter <= 26 else str(letter)
        base = f"{chrom},{span[0] + 1}-{span[1]},{tag}"
        bnd = any(e["type"] == "BND" for e in own)
        for no, e in enumerate(own, 1):
            name = f"{base}{no}"
            twin = None if e["type"] == "BND" else next((x for x in out if same_variant(x, e)), None)
            if twin is not None:
                twin["event_id"] += f";{name}"
                continue
            shared = e["type"] != "BND" and any(same_variant(e, x) for x in other)
            out.append(dict(e, event_id=name, genotype="1/1" if hom or shared else gt, complex=bnd))
    return out


def affected_length(path, blocks):
    """Total length of blocks changed in any best alignment of the path to the reference.

    ``blocks`` are half-open with novel ones last.  Alignment: match 1000, mismatch and gap -1.
    """
    n_ref = sum(not b["novel"] for b in blocks)
    ref = [(b, False) for b in range(n_ref)] + [None]
    alt = visits_of(path) + [None]
    n, m = len(ref), len(alt)
    if ref == alt:
        return 0
    same = [[1000 if r == a else -1 for a in alt] for r in ref]
    fwd = [[-max(i, j) if 0 in (i, j) else 0 for j in range(m + 1)] for i in range(n + 1)]
    bwd = [[-max(n - i, m - j) if i == n or j == m else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            fwd[i][j] = max(fwd[i - 1][j] - 1, fwd[i][j - 1] - 1, fwd[i - 1][j - 1] + same[i - 1][j - 1])
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            bwd[i][j] = max(bwd[i + 1][j] - 1, bwd[i][j + 1] - 1, bwd[i + 1][j + 1] + same[i][j])
    best, hit = fwd[n][m], set()
    for i in range(n + 1):
        for j in range(m + 1):
            here = fwd[i][j]
            if i < n and j < m and same[i][j] < 0 and here - 1 + bwd[i + 1][j + 1] == best:
                hit |= {x[0] for x in (ref[i], alt[j]) if x}
            if i < n and ref[i] and here - 1 + bwd[i + 1][j] == best:
                hit.add(ref[i][0])
            if j < m and alt[j] and here - 1 + bwd[i][j + 1] == best:
                hit.add(alt[j][0])
    return sum(blocks[b]["hi"] - blocks[b]["lo"] for b in hit)


def midpoint_blocks(blocks):
    """Blocks stretched to the midpoints of the breakpoints between them; novel ones unchanged."""
    ref = [b for b in blocks if not b["novel"]]
    cuts = [ref[0]["lo"]] + [(a["hi"] + b["lo"]) // 2 for a, b in zip(ref, ref[1:])] + [ref[-1]["hi"]]
    mid = [dict(lo=a, hi=b, novel=False) for a, b in zip(cuts, cuts[1:])]
    return cuts, mid + [b for b in blocks if b["novel"]]


def haplotype_pieces(path, blocks, flank):
    """Sequence pieces of an altered haplotype: one list per stretch between novel blocks.

    Each piece is (start, end, inverted) widened by its half of the neighbouring gaps, with the
    length deleted after it; ``inserted`` holds the novel lengths between stretches.
    """
    blocks, path, left, right = with_flanks(blocks, path, flank)
    if path == [0, 1]:
        return None
    visits = visits_of(path)
    counts = Counter(b for b, _ in visits)
    stretches, inserted = [[]], []
    for k, (b, inv) in enumerate(visits):
        if blocks[b]["novel"]:
            inserted.append(blocks[b]["hi"] - blocks[b]["lo"])
            stretches.append([])
            continue
        lo = blocks[b]["lo"] - side_gap(blocks, 2 * b) // 2
        hi = blocks[b]["hi"] + -(-side_gap(blocks, 2 * b + 1) // 2)
        lost = 0
        if k + 1 < len(visits):
            c, cinv = visits[k + 1]
            low, high = (c, b) if inv else (b, c)
            gone = inv == cinv and low + 1 < high and not blocks[c]["novel"]
            if gone and not any(counts[x] for x in range(low + 1, high)):
                lost = (blocks[high]["lo"] - side_gap(blocks, 2 * high)
                        - blocks[low]["hi"] - side_gap(blocks, 2 * low + 1))
        stretches[-1].append((lo, hi, inv, lost))
    return stretches, inserted, left, right
