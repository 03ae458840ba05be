"""Explicit schemas of the external tables."""

from pyspark.sql import types as T

ALIGNMENT = T.StructType([
    T.StructField("qname", T.StringType()), T.StructField("flag", T.IntegerType()),
    T.StructField("rname", T.StringType()), T.StructField("pos", T.IntegerType()),
    T.StructField("mapq", T.IntegerType()), T.StructField("cigar", T.StringType()),
    T.StructField("mrname", T.StringType()), T.StructField("mpos", T.IntegerType()),
    T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("lib", T.StringType()),
])

BED = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("lo", T.LongType()),
                    T.StructField("hi", T.LongType())])

FAI = T.StructType([T.StructField("name", T.StringType()), T.StructField("length", T.LongType()),
                    T.StructField("offset", T.LongType()), T.StructField("linebases", T.IntegerType()),
                    T.StructField("linewidth", T.IntegerType())])

# fixed values: column order of the call table
CALL_COLUMNS = [
    "chrom", "minbp", "maxbp", "id", "svtype", "complextype", "num_sv", "bp", "bp_uncertainty",
    "reference", "rearrangement", "len_affected", "filter", "sv_bp", "sv_bp_uncertainty", "gt",
    "af", "inslen", "sr_support", "pe_support", "score_vs_ref", "score_vs_next",
    "rearrangement_next", "num_paths"]

# fixed values: column order of the split-support table (the source names qname twice)
SPLIT_COLUMNS = [
    "sv_id", "bp", "reference", "rearrangement", "sv_bp", "support_type", "qname", "bp_idx", "bp1",
    "bp2", "bp_orientation", "qname2", "strand", "seq", "mapq", "mate_seq", "mate_mapq",
    "mate_has_split"]

SPLIT = "struct<bp1_lo:int,bp1_hi:int,bp2_lo:int,bp2_hi:int,split_type:string>"
