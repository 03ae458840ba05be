"""Seeded paired reads from altered haplotypes of a random contig, for end-to-end tests."""

import random

COMP = str.maketrans("ACGT", "TGCA")


def revcomp(s):
    return s.translate(COMP)[::-1]


def contig(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choices("ACGT", k=n))


def haplotype(segments, novel_seed=5):
    """Base-wise map of a haplotype: list of (ref position or None, strand) from (start, end, strand) pieces."""
    out = []
    for seg in segments:
        if seg[0] is None:
            out += [(None, 1)] * seg[1]
            continue
        a, b, s = seg
        out += [(p, s) for p in (range(a, b) if s > 0 else range(b - 1, a - 1, -1))]
    return out


def align(bases):
    """Collinear pieces of a read: (query lo, query hi, ref lo, ref hi, strand), longest first."""
    pieces, cur = [], None
    for q, (p, s) in enumerate(bases):
        if p is not None and cur and s == cur[4] and p == cur[5] + s:
            cur[1], cur[5] = q + 1, p
        elif p is not None:
            cur = [q, q + 1, p, None, s, p]
            pieces.append(cur)
        else:
            cur = None
    out = [(a, b, min(f, l), max(f, l) + 1, s) for a, b, f, _, s, l in pieces]
    return sorted(out, key=lambda x: x[0] - x[1])


def read_record(name, bases, strand, first, chrom, min_piece=20):
    """Primary alignment of one read (5' to 3'), or None when nothing maps."""
    if strand < 0:
        bases = [(p, -s) for p, s in reversed(bases)]
    n = len(bases)
    pieces = [p for p in align(bases) if p[1] - p[0] >= min_piece]
    if not pieces:
        return None

    def text(p):
        left, right = (p[0], n - p[1]) if p[4] > 0 else (n - p[1], p[0])
        return (f"{left}S" if left else "") + f"{p[1] - p[0]}M" + (f"{right}S" if right else "")

    main = pieces[0]
    tags = {}
    if len(pieces) > 1:
        s = pieces[1]
        tags["SA"] = f"{chrom},{s[2] + 1},{'+' if s[4] > 0 else '-'},{text(s)},60,0;"
    return dict(qname=name, rev=main[4] < 0, pos=main[2], end=main[3], cigar=text(main), tags=tags, first=first, n=n)


def simulate(haps, chrom="c1", coverage=30, read_len=100, mu=400, sd=30, seed=3, lib="lib1"):
    rng = random.Random(seed)
    rows, no = [], 0
    for hap in haps:
        for _ in range(int(len(hap) * coverage / len(haps) / (2 * read_len))):
            size = max(2 * read_len, int(rng.gauss(mu, sd)))
            at = rng.randrange(0, len(hap) - size)
            frag = hap[at:at + size]
            no += 1
            name = f"{lib}r{no}"
            recs = [read_record(name, frag[:read_len], 1, True, chrom), read_record(name, frag[-read_len:], -1, False, chrom)]
            for me, mate in (recs, recs[::-1]):
                if me is None:
                    continue
                flag = 1 | (0x40 if me["first"] else 0x80) | (0x10 if me["rev"] else 0)
                flag |= 0x8 if mate is None else (0x20 if mate["rev"] else 0)
                rows.append((name, flag, chrom, me["pos"], 60, me["cigar"], chrom, mate["pos"] if mate else me["pos"],
                             "A" * me["n"], "I" * me["n"], me["tags"], lib))
    return rows
