"""Continuous merge: raw records arrive as a stream, profiles are kept up to date in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from mergewell.operators.merge import RAW, as_raw, first_records, merge
from mergewell.settings import Settings

#: Parts of the state, by a hash of the entity; a batch reads those of its entities only.
BUCKETS = 256


def _bucket(entity: str = "entity_id") -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def merge_stream(records: DataFrame, state_path: str, output_path: str, checkpoint: str, settings: Settings = Settings(), available_now: bool = True) -> StreamingQuery:
    """Starts a query that keeps the merged profiles of a stream of raw records under ``output_path``.

    Each batch touches the entities in it only: their records so far (``state_path``, partitioned by batch and by a hash of the
    entity, of which only the parts of the batch's entities are read, the newest version of each) join the new ones, are cut to the
    wanted number per source and merged again. A batch that runs twice writes the same: the batch's number names its
    files. No watermark is needed, late records count whenever they come. State that can't be read stops the query.
    """
    spark = records.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()  # read for its entities and for its records
        try:
            new = as_raw(batch).filter("entity_id is not null")
            old = _read(spark, state_path, number, new.select("entity_id").distinct())
            if old is not None:
                new = new.unionByName(old)
            kept = first_records(new.dropDuplicates(["entity_id", "source", "rec_seq"]), settings.records_per_source)
            kept.withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/batch={number}")
        finally:
            batch.unpersist()
        done = spark.read.schema(kept.schema).parquet(f"{state_path}/batch={number}")
        profiles = merge(done, settings)
        profiles.drop(*(c for c in profiles.columns if c.startswith("d_"))).write.mode("overwrite").parquet(f"{output_path}/batch={number}")

    writer = records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _read(spark: SparkSession, path: str, before: int, wanted: DataFrame) -> DataFrame | None:
    """The newest records of the wanted entities in the batches before a number; None if nothing has been written yet."""
    if before == 0 or not _exists(spark, path):
        return None
    schema = ", ".join(f"{k} {v}" for k, v in RAW.items()) + ", batch int, bucket int"
    parts = [r[0] for r in wanted.select(_bucket()).distinct().collect()]  # BUCKETS at most
    every = spark.read.schema(schema).parquet(path).filter((F.col("batch") < before) & F.col("bucket").isin(parts)).join(wanted, "entity_id", "left_semi")
    newest = every.groupBy("entity_id").agg(F.max("batch").alias("batch"))
    return every.join(newest, ["entity_id", "batch"]).drop("batch", "bucket")


def current_profiles(spark: SparkSession, output_path: str) -> DataFrame:
    """The newest profile of each entity."""
    every = spark.read.parquet(output_path)
    newest = every.groupBy("entity_id").agg(F.max("batch").alias("batch"))
    return every.join(newest, ["entity_id", "batch"]).drop("batch")
