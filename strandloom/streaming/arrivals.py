"""Alignment files that keep arriving: the single forward pass as a file stream.

Every micro-batch is reduced to evidence rows that need no other read (split reads and soft
clips) and appended to Parquet; mates, clusters and breakpoints are then computed in batch over
the appended tables, since they need the whole region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandloom.config import CallConfig
from strandloom.functions.align import usable
from strandloom.plans.evidence import softclip_evidence, with_geometry, with_splits
from strandloom.schemas import ALIGNMENT


def append_clips(spark: SparkSession, source: str, target: str, checkpoint: str,
                 cfg: CallConfig = CallConfig()) -> StreamingQuery:
    """Stream Parquet alignments from ``source`` and append soft-clip evidence to ``target``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        reads = with_splits(with_geometry(batch.where(usable())), cfg).persist()
        softclip_evidence(reads, cfg).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        reads.unpersist()

    # one folder per batch id makes a replayed batch overwrite itself
    return (spark.readStream.schema(ALIGNMENT).parquet(source).writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
