"""Alignment sources: SAM text, BAM files and Parquet, all in the ALIGNMENT schema."""

from __future__ import annotations

import os
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.config import Region
from strandloom.functions.align import cigar_ops, reference_length
from strandloom.schemas import ALIGNMENT


def in_region(df: DataFrame, region: Region) -> DataFrame:
    """Alignments overlapping a region; the contig and start tests reach a Parquet scan."""
    out = df.where(F.col("rname") == region.chrom)
    if region.start is not None:
        out = out.where((F.col("pos") < region.end)
                        & (F.col("pos") + reference_length(cigar_ops(F.col("cigar"))) > region.start))
    return out


def read_sam(spark: SparkSession, paths: str | list[str], lib: str = "lib1") -> DataFrame:
    """SAM text; files are concatenated."""
    f = F.split("value", "\t")
    tag = lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 1 << 30).alias("value"))
    tags = F.map_from_entries(F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), tag))
    rname = F.when(f[2] != "*", f[2])
    return spark.read.text(paths).where(~F.col("value").startswith("@")).select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), rname.alias("rname"),
        (f[3].cast("int") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"),
        F.when(f[6] == "=", rname).when(f[6] != "*", f[6]).alias("mrname"), (f[7].cast("int") - 1).alias("mpos"),
        f[9].alias("seq"), f[10].alias("qual"), tags.alias("tags"), F.lit(lib).alias("lib"))


def sam_contigs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(rname, tid, length) from SAM header lines; one row per contig."""
    sq = spark.read.text(paths).where(F.col("value").startswith("@SQ\t")).select(
        F.regexp_extract("value", r"SN:([^\t]+)", 1).alias("rname"),
        F.regexp_extract("value", r"LN:(\d+)", 1).cast("bigint").alias("length"),
        F.monotonically_increasing_id().alias("_o"))
    from pyspark.sql import Window
    return sq.withColumn("tid", F.row_number().over(Window.orderBy("_o")) - 1).select("rname", "tid", "length")


# --- BAM -----------------------------------------------------------------------------------

_BASES = "=ACMGRSVTWYHKDBN"  # fixed values: 4-bit base codes
_OPS = "MIDNSHP=X"  # fixed values: CIGAR operation codes
_TAG_SIZE = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_CODE = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def _block_at(f, offset: int):
    """(payload, next offset) of the compressed block at ``offset``; None at the end."""
    f.seek(offset)
    head = f.read(18)
    if len(head) < 18:
        return None
    if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
        raise ValueError(f"no block header at {offset}")
    size = struct.unpack("<H", head[16:18])[0] + 1
    body = f.read(size - 18)
    return zlib.decompress(body[:-8], -15), offset + size


def _first_block(f, start: int, size: int) -> int | None:
    """Offset of the first valid compressed block at or after ``start``."""
    at, window = start, 1 << 17
    while at < size:
        f.seek(at)
        buf = f.read(window)
        i = buf.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            try:
                _block_at(f, at + i)
                return at + i
            except (ValueError, zlib.error, struct.error):
                i = buf.find(b"\x1f\x8b\x08\x04", i + 1)
        at += max(1, len(buf) - 3)
        if len(buf) < window:
            return None
    return None


class _Stream:
    """Record bytes from compressed blocks, knowing in which block each record starts."""

    def __init__(self, f, offset):
        self.f, self.next, self.buf, self.at = f, offset, b"", 0
        self.marks = []  # (position in buf, offset of its block)

    def fill(self, need: int) -> bool:
        while len(self.buf) - self.at < need:
            got = _block_at(self.f, self.next)
            if got is None:
                return False
            here, (data, self.next) = self.next, got
            drop = self.at
            self.buf, self.at = self.buf[drop:], 0
            moved = [(p - drop, o) for p, o in self.marks]
            # blocks wholly behind the cursor are forgotten, except the one the cursor is in
            self.marks = [x for x in moved if x[0] <= 0][-1:] + [x for x in moved if x[0] > 0]
            self.marks.append((len(self.buf), here))
            self.buf += data
        return True

    def block_of_cursor(self) -> int:
        return max((o for p, o in self.marks if p <= self.at), default=0)

    def block_at(self, position: int) -> int:
        return max((o for p, o in self.marks if p <= position), default=0)

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise EOFError
        out = self.buf[self.at:self.at + n]
        self.at += n
        return out


def _chained(stream: _Stream, at: int, n_ref: int, depth: int) -> bool:
    """Whether ``depth`` complete, well-formed records follow each other from ``at``, or fewer up to the end of the file.

    The buffer grows until the chain is decided, so records may be of any length.
    """
    for seen in range(depth):
        if not stream.fill(at + 36):
            return seen > 0 and at == len(stream.buf)
        size, tid, pos, name_len, _, _, n_cigar, _, l_seq, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", stream.buf, at)
        if not (size >= 32 and -1 <= tid < n_ref and -1 <= mtid < n_ref and pos >= -1 and mpos >= -1 and name_len >= 2
                and l_seq >= 0 and size >= 32 + name_len + 4 * n_cigar + (l_seq + 1) // 2 + l_seq):
            return False
        if not stream.fill(at + 36 + name_len):
            return False
        name = stream.buf[at + 36:at + 36 + name_len]
        if name[-1] or not all(32 < c < 127 for c in name[:-1]):
            return False
        at += 4 + size
    return stream.fill(at)


def _first_record(stream: _Stream, n_ref: int, end: int) -> int | None:
    """Position of the first record that starts in a block before ``end``."""
    at = 0
    while stream.fill(at + 36) and stream.block_at(at) < end:
        if _chained(stream, at, n_ref, 6):
            return at
        at += 1
    return None


def read_bam_header(path: str):
    """(contig names, lengths, stream positioned at the first record)."""
    f = open(path, "rb")
    s = _Stream(f, 0)
    if s.take(4) != b"BAM\x01":
        raise ValueError(f"{path} is not a BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    names, lengths = [], []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        n = struct.unpack("<i", s.take(4))[0]
        names.append(s.take(n)[:-1].decode())
        lengths.append(struct.unpack("<i", s.take(4))[0])
    return names, lengths, s


def _tags(raw: bytes) -> dict:
    out, at = {}, 0
    while at + 3 <= len(raw):
        key, kind = raw[at:at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[key], at = raw[at:end].decode(), end + 1
        elif kind == "A":
            out[key], at = chr(raw[at]), at + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            step = _TAG_SIZE[sub]
            vals = [struct.unpack_from(_TAG_CODE[sub], raw, at + 5 + i * step)[0] for i in range(n)]
            out[key], at = f"{sub}," + ",".join(map(str, vals)), at + 5 + n * step
        else:
            out[key] = str(struct.unpack_from(_TAG_CODE[kind], raw, at)[0])
            at += _TAG_SIZE[kind]
    return out


def _record(raw: bytes, names: list[str], lib: str) -> tuple:
    tid, pos, name_len, mapq, _, n_cigar, flag, l_seq, mtid, mpos, _ = struct.unpack_from("<iiBBHHHiiii", raw, 0)
    at = 32
    qname = raw[at:at + name_len - 1].decode()
    at += name_len
    ops = struct.unpack_from(f"<{n_cigar}I", raw, at)
    at += 4 * n_cigar
    packed = raw[at:at + (l_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
    at += len(packed)
    qual = raw[at:at + l_seq]
    text = "*" if l_seq and qual[0] == 255 else "".join(chr(q + 33) for q in qual)
    name = lambda t: names[t] if t >= 0 else None
    return (qname, flag, name(tid), pos, mapq, "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*",
            name(mtid), mpos, seq or "*", text, _tags(raw[at + l_seq:]), lib)


class _Split(InputPartition):
    def __init__(self, path, start, end):
        self.path, self.start, self.end = path, start, end


class BamReader(DataSourceReader):
    """Byte-range splits of BAM files; every split finds its own first record."""

    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.split = int(options.get("splitbytes", 64 << 20))
        self.lib = options.get("lib", "lib1")
        self.chrom = options.get("chrom")
        self.start, self.end = options.get("start"), options.get("end")

    def partitions(self):
        out = []
        for path in self.paths:
            size = os.path.getsize(path)
            out += [_Split(path, a, min(size, a + self.split)) for a in range(0, size, self.split)]
        return out

    def read(self, part):
        names, _, stream = read_bam_header(part.path)
        with stream.f:
            yield from self._records(part, names, stream)

    def _records(self, part, names, stream):
        if part.start > 0:
            size = os.path.getsize(part.path)
            offset = _first_block(stream.f, part.start, size)
            if offset is None or offset >= part.end:
                return
            # records of the header block's tail belong to the first split
            if offset <= stream.block_of_cursor():
                return
            stream = _Stream(stream.f, offset)
            first = _first_record(stream, len(names), part.end)
            if first is None:
                return
            stream.at = first
        want = None if self.start is None else (int(self.start), int(self.end))
        while stream.fill(4) and stream.block_of_cursor() < part.end:
            raw = stream.take(struct.unpack("<i", stream.take(4))[0])
            tid, pos = struct.unpack_from("<ii", raw, 0)
            if self.chrom is not None and (tid < 0 or names[tid] != self.chrom):
                continue
            if want and pos >= want[1]:
                continue
            yield _record(raw, names, self.lib)


class BamDataSource(DataSource):
    """``spark.read.format("bam").load(path)`` with optional chrom, start, end, lib, splitbytes."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return ALIGNMENT

    def reader(self, schema):
        return BamReader(self.options)


def read_bam(spark: SparkSession, paths: str | list[str], region: Region | None = None, lib: str = "lib1",
             split_bytes: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(BamDataSource)
    joined = paths if isinstance(paths, str) else ",".join(paths)
    reader = spark.read.format("bam").option("lib", lib).option("splitbytes", split_bytes)
    if region is not None:
        reader = reader.option("chrom", region.chrom)
        if region.start is not None:
            reader = reader.option("start", region.start).option("end", region.end)
    df = reader.load(joined)
    return df if region is None else in_region(df, region)


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(rname, tid, length) from the BAM header; one row per contig."""
    names, lengths, _ = read_bam_header(path)
    return spark.createDataFrame([(n, i, l) for i, (n, l) in enumerate(zip(names, lengths))],
                                 "rname string, tid int, length bigint")


def sorted_scan(df: DataFrame) -> DataFrame:
    return df.orderBy("rname", "pos", "qname", "flag")
