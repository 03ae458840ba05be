"""Column expressions over alignment records: flags, CIGAR, MD, clips, splits.

Everything here is built from JVM-side functions; a CIGAR is parsed once into an array of
``struct<op, len>`` and the rest are higher-order functions on that array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: SAM flag bits
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x4, 0x8, 0x10, 0x20
READ1, SECONDARY, DUPLICATE, SUPPLEMENTARY = 0x40, 0x100, 0x400, 0x800


def has_flag(flag, bits: int) -> Column:
    return F.col(flag).bitwiseAND(bits) != 0 if isinstance(flag, str) else flag.bitwiseAND(bits) != 0


def not_primary(flag="flag") -> Column:
    return has_flag(flag, SECONDARY | SUPPLEMENTARY)


def usable(flag="flag") -> Column:
    """Primary, mapped and not a duplicate."""
    return ~has_flag(flag, SECONDARY | SUPPLEMENTARY | UNMAPPED | DUPLICATE)


def fully_aligned(ops: Column) -> Column:
    return (clip_left(ops) == 0) & (clip_right(ops) == 0)


def hanging_class(rname: Column, mrname: Column, pos: Column, mpos: Column, unmapped: Column,
                  mate_unmapped: Column, max_dist: int) -> Column:
    return (F.when(rname != mrname, "dist_other_chrom")
            .when(F.abs(pos - mpos) >= max_dist, "dist_same_chrom")
            .when(unmapped != mate_unmapped, "unmapped"))


# --- CIGAR -----------------------------------------------------------------

def cigar_ops(cigar: Column) -> Column:
    """``array<struct<op:string,len:int>>``."""
    tokens = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(tokens, lambda t: F.struct(
        F.right(t, F.lit(1)).alias("op"),
        F.substring(t, F.lit(1), F.length(t) - 1).cast("int").alias("len")))


def _sum_ops(ops: Column, kinds: str) -> Column:
    return F.aggregate(ops, F.lit(0), lambda acc, o: acc + F.when(
        o["op"].isin(*kinds), o["len"]).otherwise(0))


def reference_length(ops: Column) -> Column:
    return _sum_ops(ops, "MDN=X")


def query_length(ops: Column) -> Column:
    return _sum_ops(ops, "MIS=X")


def aligned_length(ops: Column) -> Column:
    """Query bases between the soft clips."""
    return _sum_ops(ops, "MI=X")


def _leading(ops: Column, kind: str) -> Column:
    """Length of clips of one kind before the first aligned operation."""
    start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("n"))
    return F.aggregate(
        ops, start,
        lambda acc, o: F.struct(
            (acc["open"] & o["op"].isin("S", "H", "P")).alias("open"),
            (acc["n"] + F.when(acc["open"] & (o["op"] == kind), o["len"]).otherwise(0)).alias("n")),
        lambda acc: acc["n"])


def clip_left(ops: Column) -> Column:
    return _leading(ops, "S")


def clip_right(ops: Column) -> Column:
    return _leading(F.reverse(ops), "S")


def query_coords(ops: Column, is_reverse: Column) -> Column:
    """1-based closed query span from the 5' end; an insertion before any match is a clip."""
    oriented = F.when(is_reverse, F.reverse(ops)).otherwise(ops)
    zero = F.struct(F.lit(0).alias("lead"), F.lit(0).alias("body"), F.lit(0).alias("pend"),
                    F.lit(False).alias("seen"), F.lit(0).alias("i"))

    def step(acc, o):
        is_m = o["op"].isin("M", "=", "X")
        is_i = o["op"] == "I"
        lead = ((~acc["seen"] & is_i) | ((acc["i"] == 0) & o["op"].isin("S", "H")))
        return F.struct(
            (acc["lead"] + F.when(lead, o["len"]).otherwise(0)).alias("lead"),
            (acc["body"] + F.when(is_m, o["len"] + acc["pend"]).otherwise(0)).alias("body"),
            F.when(is_m, 0).when(is_i & acc["seen"], o["len"]).otherwise(acc["pend"]).alias("pend"),
            (acc["seen"] | is_m).alias("seen"), (acc["i"] + 1).alias("i"))

    return F.aggregate(oriented, zero, step, lambda a: F.struct(
        (a["lead"] + 1).alias("start"), (a["lead"] + a["body"]).alias("end")))


def match_blocks(ops: Column, pos: Column) -> Column:
    """``struct<blocks array<struct<start,end>>, gaps array<int>>``.

    ``gaps[k]`` is the number of query bases between match block k-1 and k (ends included).
    """
    pos = pos.cast("int")
    blocks0 = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(blocks0.alias("blocks"), F.array().cast("array<int>").alias("gaps"),
                    pos.alias("at"), F.lit(0).alias("gap"), F.lit(False).alias("seen"))

    def step(acc, o):
        is_m = o["op"].isin("M", "=", "X")
        block = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + o["len"]).alias("end")))
        on_ref = is_m | (acc["seen"] & o["op"].isin("D", "N"))
        return F.struct(
            F.when(is_m, F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"),
            F.when(is_m, F.array_append(acc["gaps"], acc["gap"])).otherwise(acc["gaps"]).alias("gaps"),
            (acc["at"] + F.when(on_ref, o["len"]).otherwise(0)).alias("at"),
            F.when(is_m, 0).when(o["op"].isin("I", "S"), acc["gap"] + o["len"])
            .otherwise(acc["gap"]).alias("gap"),
            (acc["seen"] | is_m).alias("seen"))

    return F.aggregate(ops, zero, step, lambda a: F.struct(
        a["blocks"].alias("blocks"), F.array_append(a["gaps"], a["gap"]).alias("gaps")))


def reference_positions(ops: Column, pos: Column) -> Column:
    """Reference position of every query base (soft clips included), NULL where unaligned."""
    zero = F.struct(F.array().cast("array<int>").alias("refs"), pos.cast("int").alias("at"))

    def step(acc, o):
        run = F.sequence(acc["at"], acc["at"] + o["len"] - 1)
        none = F.array_repeat(F.lit(None).cast("int"), o["len"])
        refs = (F.when(o["op"].isin("M", "=", "X"), F.concat(acc["refs"], run))
                .when(o["op"].isin("I", "S"), F.concat(acc["refs"], none)).otherwise(acc["refs"]))
        moved = F.when(o["op"].isin("M", "=", "X", "D", "N"), o["len"]).otherwise(0)
        return F.struct(refs.alias("refs"), (acc["at"] + moved).alias("at"))

    return F.aggregate(ops, zero, step, lambda a: a["refs"])


# --- qualities and soft clips ------------------------------------------------

def lowqual_run(qual: Column, left: bool, slop: int) -> Column:
    """Length of the run of quality characters # ! \" at one end, plus ``slop`` if any."""
    run = F.length(F.regexp_extract(qual, '^[#!"]*' if left else '[#!"]*$', 0))
    return F.when(run > 0, run + slop).otherwise(0)


def median_quality(qual: Column, start: Column, length: Column) -> Column:
    """Median Phred score of ``length`` characters from 0-based ``start``."""
    scores = F.array_sort(F.transform(
        F.split(F.substring(qual, start + 1, length), ""), lambda c: F.ascii(c) - 33))
    half = F.floor(length / 2).cast("int")
    return F.when(length % 2 == 1, F.element_at(scores, half + 1).cast("double")).otherwise(
        (F.element_at(scores, half) + F.element_at(scores, half + 1)) / 2.0)


# --- sequences -----------------------------------------------------------------

# fixed values: IUPAC complements
_BASES = "ATCGNRYWSMKBVDHatcgnrywsmkbvdh"
_COMPLEMENTS = "TAGCNYRWSKMVBHDtagcnyrwskmvbhd"


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), _BASES, _COMPLEMENTS)


def ucsc_name(chrom: Column) -> Column:
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


# --- SA and MD tags ----------------------------------------------------------------

def parse_sa(sa: Column) -> Column:
    """``array<struct<rname,pos,is_reverse,cigar,mapq>>`` with 0-based positions."""
    items = F.filter(F.split(sa, ";"), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(
        F.split(x, ",")[0].alias("rname"), (F.split(x, ",")[1].cast("int") - 1).alias("pos"),
        (F.split(x, ",")[2] == "-").alias("is_reverse"), F.split(x, ",")[3].alias("cigar"),
        F.split(x, ",")[4].cast("int").alias("mapq")))


def md_tokens(md: Column) -> Column:
    """Match runs, single mismatches and ``^`` deletions of an MD string, in order."""
    return F.filter(F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Za-z]+|[A-Za-z])"), F.lit(1)),
                    lambda t: t != "0")


def md_mismatch_offsets(md: Column) -> Column:
    """0-based offsets of mismatches along the aligned (M) bases."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))

    def step(acc, t):
        number, deletion = t.rlike(r"^\d+$"), t.startswith("^")
        mismatch = ~number & ~deletion
        return F.struct(
            (acc["at"] + F.when(number, t.try_cast("int")).when(mismatch, 1).otherwise(0)).alias("at"),
            F.when(mismatch, F.array_append(acc["hits"], acc["at"])).otherwise(acc["hits"]).alias("hits"))

    return F.aggregate(md_tokens(md), zero, step, lambda a: a["hits"])


def insertion_sites(ops: Column) -> Column:
    """``array<struct<at,len>>``: insertions located by the number of M bases before them."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,len:int>>").alias("hits"))

    def step(acc, o):
        site = F.array(F.struct(acc["at"].alias("at"), o["len"].alias("len")))
        return F.struct(
            (acc["at"] + F.when(o["op"].isin("M", "=", "X"), o["len"]).otherwise(0)).alias("at"),
            F.when(o["op"] == "I", F.concat(acc["hits"], site)).otherwise(acc["hits"]).alias("hits"))

    return F.aggregate(ops, zero, step, lambda a: a["hits"])


def mismatch_positions(ops: Column, md: Column, is_reverse: Column) -> Column:
    """0-based mismatch offsets along query bases between the clips, counted from the 5' end.

    Insertions shift the mismatches after them.
    """
    ins = insertion_sites(ops)
    shifted = F.transform(md_mismatch_offsets(md), lambda m: m + F.aggregate(
        ins, F.lit(0), lambda acc, s: acc + F.when(s["at"] <= m, s["len"]).otherwise(0)))
    total = aligned_length(ops)
    return F.when(is_reverse, F.reverse(F.transform(shifted, lambda m: total - 1 - m))).otherwise(shifted)


# --- split reads --------------------------------------------------------------------

# fixed values: split class by strand of the first and second piece and their order
_SAME = {(True, False): "Del+", (False, False): "Del-", (True, True): "Dup+", (False, True): "Dup-"}
_CROSS = {(True, True): "InvL+", (True, False): "InvL-", (False, True): "InvR+", (False, False): "InvR-"}


def split_type(first_plus: Column, second_plus: Column, overlap: Column, left_first: Column) -> Column:
    same = F.lit(None).cast("string")
    for (plus, over), name in _SAME.items():
        same = F.when((first_plus == plus) & (overlap == over), name).otherwise(same)
    cross = F.lit(None).cast("string")
    for (plus, left), name in _CROSS.items():
        cross = F.when((first_plus == plus) & (left_first == left), name).otherwise(cross)
    return F.when(first_plus == second_plus, same).otherwise(cross)


def aligned_indices(refs: Column) -> Column:
    """Indices of the aligned bases of a reference-position array."""
    return F.filter(F.transform(refs, lambda x, i: F.when(x.isNotNull(), i)), lambda x: x.isNotNull())


def junction_interval(refs: Column, i: Column, j: Column, plus_one: Column) -> Column:
    """Closed interval spanned by two bases of a piece, moved by one where the junction lies after them."""
    a, b = F.get(refs, i), F.get(refs, j)
    add = F.when(plus_one, 1).otherwise(0)
    return F.struct((F.least(a, b) + add).alias("lo"), (F.greatest(a, b) + add).alias("hi"))
