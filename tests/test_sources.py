import re
import random
import struct
import zlib

from pyspark.sql import functions as F

from strandloom.config import Region, parse_region, preset
from strandloom.functions import align as A
from strandloom.plans import filter_merge as M
from strandloom.schemas import CALL_COLUMNS
from strandloom.sources import alignments as S
from strandloom.sources import tables as T
from strandloom.sources import writers as W


def bgzf(data):
    out = b""
    for i in range(0, len(data) + 1, 20000):
        part = data[i:i + 20000]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body
                + struct.pack("<II", zlib.crc32(part), len(part)))
    return out


def bam_bytes(rows, contigs):
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(contigs))
    for n, l in contigs:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", l)
    body = b""
    for name, flag, tid, pos, seq, sa in rows:
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        tags = b"SAZ" + sa.encode() + b"\0NMi" + struct.pack("<i", 3) if sa else b""
        rec = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 40, 0, 1, flag, len(seq), tid, pos + 5, 0)
        rec += name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes([30]) * len(seq) + tags
        body += struct.pack("<i", len(rec)) + rec
    return bgzf(head + body)


def test_bam_splits_read_every_record_once(spark, tmp_path):
    rows = [(f"read{i}", 99, i % 2, i * 10, "ACGTN" * (3 + i % 7), "c1,5,+,10M,60,0;" if i % 5 == 0 else "") for i in range(3000)]
    path = str(tmp_path / "x.bam")
    with open(path, "wb") as f:
        f.write(bam_bytes(rows, [("c0", 100000), ("c1", 100000)]))
    for split in (1 << 26, 3000, 9001):
        got = S.read_bam(spark, path, split_bytes=split).select("qname", "rname", "pos", "seq", F.col("tags")["SA"].alias("sa"), "cigar").collect()
        assert sorted((r.qname, r.rname, r.pos, r.seq, r.sa or "", r.cigar) for r in got) == sorted(
            (n, f"c{t}", p, s, sa, f"{len(s)}M") for n, _, t, p, s, sa in rows)
    some = S.read_bam(spark, path, Region("c0", 100, 200)).count()
    assert some == sum(t == 0 and p < 200 and p + len(s) > 100 for _, _, t, p, s, _ in rows)
    assert [(r.rname, r.tid, r.length) for r in S.bam_contigs(spark, path).orderBy("tid").collect()] == [("c0", 0, 100000), ("c1", 1, 100000)]


def test_sam_text(spark, tmp_path):
    p = tmp_path / "x.sam"
    p.write_text("@HD\tVN:1.6\n@SQ\tSN:c1\tLN:500\nr1\t99\tc1\t11\t60\t5S20M\t=\t101\t0\tACGT\tIIII\tSA:Z:c1,50,-,20M5S,60,0;\tNM:i:0\n")
    r = S.read_sam(spark, str(p)).first()
    assert (r.qname, r.pos, r.mpos, r.mrname, r.tags["SA"]) == ("r1", 10, 100, "c1", "c1,50,-,20M5S,60,0;")
    assert [tuple(x) for x in S.sam_contigs(spark, str(p)).collect()] == [("c1", 0, 500)]


def test_fasta_fetch(spark, tmp_path):
    seq = "ACGTTGCAAC" * 23
    lines = [seq[i:i + 60] for i in range(0, len(seq), 60)]
    fa = tmp_path / "r.fa"
    fa.write_text(">c1\n" + "\n".join(lines).lower() + "\n")
    (tmp_path / "r.fa.fai").write_text(f"c1\t{len(seq)}\t4\t60\t61\n")
    chunks, fai = T.fasta_chunks(spark, str(fa), 37), T.read_fai(spark, str(fa))
    want = [(1, 0, 5, False), (2, 30, 120, False), (3, -4, 6, False), (4, 225, 240, True), (5, -9, -2, False)]
    reg = spark.createDataFrame([(i, "c1", a, b, v) for i, a, b, v in want], "id int, chrom string, start bigint, end bigint, inverted boolean")
    got = {r.id: r.seq for r in T.fetch_sequences(reg, chunks, fai, ["id"], chunk=37).collect()}
    comp = str.maketrans("ACGTN", "TGCAN")
    for i, a, b, v in want:
        text = "".join(seq[x] if 0 <= x < len(seq) else "N" for x in range(a, b))
        assert got[i] == (text.translate(comp)[::-1] if v else text), i


def test_call_table_round_trip(spark, tmp_path):
    row = ["20", 135114, 136566, "20_134442-138578", "BND,BND", "ddup.del", 2, "1,2", "0,0", "ABCDE", "ADCDE", 35, "PASS", "1,2;3,4", "4,4;0,0",
           "HOM", "1.000", "NA", "17,14", "0,0", "244.29", "15.23", "ABCDE/ADCDE", 17]
    df = spark.createDataFrame([row], ", ".join(f"`{c}` {'bigint' if isinstance(v, int) else 'string'}" for c, v in zip(CALL_COLUMNS, row)))
    W.write_calls(df, str(tmp_path / "a" / "calls.tab"))
    got = T.read_calls(spark, [str(tmp_path / "a"), str(tmp_path / "missing")])
    assert list(got.first()) == row
    keep = lambda **o: M.filter_merge(got, M.FilterOptions(**o)).count()
    assert keep() == 1 and keep(min_sr_support=15) == 0 and keep(exclude=("complex",)) == 0 and keep(exclude=("simple",)) == 1


def test_foreign_vcf(spark, tmp_path):
    p = tmp_path / "d.vcf"
    tail = "GT\t"
    p.write_text("##x\n" + "\n".join([
        "c1\t100\ta\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=300;CIPOS=-5,5;CIEND=-2,2;PRECISE;PE=3\t" + tail + "0/1",
        "c1\t100\tb\tN\t<INS>\t.\tPASS\tSVTYPE=INS;END=101;INSLEN=40\t" + tail + "1/1",
        "c1\t100\tc\tN\t<TRA>\t.\tPASS\tSVTYPE=TRA;END=300\t" + tail + "1/1"]) + "\n")
    rows = {r.id: r for r in T.convert_vcf(T.read_vcf(spark, str(p))).collect()}
    assert set(rows) == {"a", "b"}
    a = rows["a"]
    assert ([tuple(x) for x in a.bp], a.path1, a.path2, a.pe, a.filter) == ([(95, 105), (298, 302)], [0, 1, 4, 5], [0, 1, 2, 3, 4, 5], 3, "PASS:PRECISE")
    assert rows["b"].path1 == [0, 1, 4, 5, 2, 3] == rows["b"].path2 and rows["b"].inslen == 40
    assert spark.range(1).select(T.svelter_path(F.lit("ab^a"), F.lit(4))).first()[0] == [0, 1, 2, 3, 5, 4, 2, 3, 6, 7]


def test_bam_splits_with_very_long_records(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(9):
        n = rng.choice([40, 1_000_000, 400_000])
        rows.append((f"read{i}", 0, 0, 100 * i, "".join(rng.choices("ACGT", k=1000)) * (n // 1000) + "A" * (n % 1000), ""))
    path = str(tmp_path / "long.bam")
    with open(path, "wb") as f:
        f.write(bam_bytes(rows, [("c0", 10_000_000)]))
    for split in (1 << 30, 300_000, 70_000):
        got = S.read_bam(spark, path, split_bytes=split).select("qname", F.length("seq").alias("n")).collect()
        assert sorted((r.qname, r.n) for r in got) == sorted((r[0], len(r[4])) for r in rows), split


def test_cigar_against_a_walk(spark):
    """Blocks of matches on the reference, and unmatched read bases around them, by walking base for base."""
    rng = random.Random(6)
    cigars = set()
    for _ in range(40):
        ops = [rng.choice(["", f"{rng.randint(1, 9)}S"])]
        for k in range(rng.randint(1, 4)):
            ops.append(f"{rng.randint(5, 30)}M" if k == 0 else f"{rng.randint(1, 9)}{rng.choice('ID')}{rng.randint(5, 30)}M")
        cigars.add("".join(ops) + rng.choice(["", f"{rng.randint(1, 9)}S"]))

    def walk(cigar):
        at, blocks, gaps, free = 37, [], [], 0
        for n, op in re.findall(r"(\d+)([MIDS])", cigar):
            if op == "M":
                blocks.append((at, at + int(n)))
                gaps.append(free)
                free = 0
            free += int(n) if op in "IS" else 0
            at += int(n) if op in "MD" else 0
        return blocks, [*gaps, free]

    df = spark.createDataFrame([(c,) for c in sorted(cigars)], "c string")
    for r in df.select("c", A.match_blocks(A.cigar_ops(F.col("c")), F.lit(37)).alias("m")).collect():
        assert ([tuple(b) for b in r.m.blocks], r.m.gaps) == walk(r.c), r.c


def test_parameters():
    assert parse_region("20:0-250000") == Region("20", 0, 250000) and parse_region("X") == Region("X")
    assert preset("high").min_edge_support == 3 and preset().symmetric_fractions == [0.5]


def test_calls_are_sorted_and_filtered_without_work_per_comparison(spark):
    rows = [("10", 5, "a", "DEL", "ABC"), ("2", 5, "b", "DEL,DUP", "ABC"), ("chrX", 1, "c_1", "DEL", "ABC"), ("_u", 1, "d", "DEL", None), ("2", 5, "a", "INV,DEL", "ABC"),
            ("chr2", 4, "e", "DEL", "AB_C"), ("M", 9, "f", "odd", "ABC"), ("3", 9, None, "BND,BND", "ABC"), ("3", 1, "g", None, "ABC"), ("4", 1, "h", "DEL,odd", "ABC")]
    calls = spark.createDataFrame(rows, "chrom string, minbp long, id string, svtype string, rearrangement string").selectExpr(
        "*", "minbp + 10 AS maxbp", "100 AS len_affected", "'3,4' AS sr_support", "'2' AS pe_support", "0.5 AS af")
    ordered = M.sort_calls(calls)
    assert [(r["chrom"], r["id"]) for r in ordered.collect()] == [("chr2", "e"), ("2", "a"), ("2", "b"), ("3", "g"), ("3", None), ("4", "h"), ("10", "a"), ("M", "f"), ("chrX", "c_1"), ("_u", "d")]
    sorts = [x for x in ordered._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Sort [" in x]
    assert sorts and not any("regexp" in x or "RLIKE" in x for x in sorts)
    kept = lambda *names: {(r["chrom"], r["id"]) for r in M.filter_calls(calls, M.FilterOptions(exclude=names)).collect()}
    assert kept("inversions") == {("10", "a"), ("2", "b"), ("chrX", "c_1"), ("_u", "d"), ("chr2", "e"), ("3", None)}
    assert kept("insertions", "compoundhet") == {("10", "a"), ("2", "b"), ("2", "a"), ("_u", "d"), ("3", None)}
    assert kept("simple", "complex") == set() and len(kept()) == 10
