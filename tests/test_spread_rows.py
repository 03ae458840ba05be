"""A task's rows do not grow with the table: partitions are counted by rows, not by the session's setting."""

from strandloom import session as S
from strandloom.plans import catalogue as C
from strandloom.plans import catalogue_validation as V

SF = "/root/testdata/sf0.001"


def test_window_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 500)
    n = -(-C.table(spark, SF, "lineitem").count() // 500)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert V.pieces_of(spark, SF).rdd.getNumPartitions() == n
    assert C.likelihood_of(spark, SF)[0].rdd.getNumPartitions() == n
