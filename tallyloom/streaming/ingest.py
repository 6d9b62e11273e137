"""Additions beyond batch: incremental ingest of facts and appending of audits, as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.functions.keys import dedup_key
from tallyloom.operators.validation import fact_issues
from tallyloom.sources.schemas import FACT


def fact_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New files of facts under a folder."""
    return spark.readStream.schema(FACT).option("maxFilesPerTrigger", per_trigger).json(path)


def fresh_facts(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """Valid facts, each key once.  With ``delay``, keys are forgotten that long after their event time ``ts``."""
    valid = stream.filter(F.size(fact_issues()) == 0)
    keyed = valid.withColumn("dedup_key", dedup_key(*[F.col(c) for c in ("entity", "metric", "date", "value_text", "unit", "fact")]))
    if delay:
        return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dedup_key"])
    return keyed.dropDuplicates(["dedup_key"])


def append_audits(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scored trajectories appended as JSON lines, each once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_rewards(stream: DataFrame, ts: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Count and mean reward per window of event time, late rows up to ``delay``."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, window)).agg(F.count("*").alias("n"), F.avg("reward.total").alias("reward_mean"))
