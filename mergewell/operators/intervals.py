"""Continuous periods and gaps of dated intervals per entity (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mergewell.functions.months import is_ongoing, month_index, month_text


def merge_intervals(df: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """(key, kind, first, last) of the periods that the integer intervals [start, end] form, and of the gaps between.

    Intervals that share a unit or follow in the next one form one ``period``; each stretch between two
    successive periods is one ``gap``. Rows with a null key, start or end, or that end before they start, are left
    out; repeated rows change nothing; an empty table gives an empty result. Columns of df clash with nothing: only
    the expressions given are read.

    The merge is Spark's own session window with a duration of each row's own: a unit is one day of a synthetic
    clock, so an interval is a session of (end - start + 1) days, and Spark unites the sessions that overlap.
    Before that the intervals are made distinct, on the map side too: a key has at most as many different ones as
    there are pairs of units, however many rows it holds. Sessions that only touch are united afterwards, with lag
    over the few rows left per key. One shuffle on the key serves all steps.
    """
    rows = df.select(F.col(key).alias("_k"), start.cast("long").alias("_s"), end.cast("long").alias("_e"))
    rows = rows.filter("_k is not null and _s is not null and _e >= _s")
    # Of the intervals with the same start only the longest counts: one row per key and start leaves the map side.
    rows = rows.groupBy("_k", "_s").agg(F.max("_e").alias("_e"))
    clock = F.timestamp_seconds(F.col("_s") * 86400)
    duration = F.concat((F.col("_e") - F.col("_s") + 1).cast("string"), F.lit(" days"))
    sessions = (
        rows.withColumn("_t", clock)
        .groupBy("_k", F.session_window("_t", duration).alias("_w"))
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    )
    by_key = Window.partitionBy("_k").orderBy("_s")
    touching = sessions.withColumn("_new", F.when(F.col("_s") <= F.lag("_e").over(by_key) + 1, 0).otherwise(1))
    numbered = touching.withColumn("_n", F.sum("_new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    periods = numbered.groupBy("_k", "_n").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    following = periods.withColumn("_next", F.lead("_s").over(by_key))
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_s").alias("first"), F.col("_e").alias("last")),
        F.struct(F.lit("gap").alias("kind"), (F.col("_e") + 1).alias("first"), (F.col("_next") - 1).alias("last")),
    )
    return following.select(F.col("_k").alias(key), F.inline(F.filter(both, lambda x: x["last"].isNotNull())))


def employment_periods(experience: DataFrame, records: DataFrame) -> DataFrame:
    """(raw_id, kind, first_month, last_month) of each record's periods of employment and the gaps between them.

    An entry runs from the month of start_date to that of end_date. If is_current is true, or end_date is null,
    blank or says that the job goes on, it runs to the month of the record's extracted_at. Entries without a readable
    start, with an unreadable end, without a record or extraction time that they need, or ending before they start,
    are left out. is_current null counts as false.
    """
    seen = records.select("raw_id", (F.year("extracted_at") * 12 + F.month("extracted_at") - 1).alias("_seen")).groupBy("raw_id").agg(F.max("_seen").alias("_seen"))
    entries = experience.select(
        "raw_id",
        month_index(F.col("start_date")).alias("_start"),
        month_index(F.col("end_date")).alias("_end"),
        (F.coalesce("is_current", F.lit(False)) | is_ongoing(F.col("end_date"))).alias("_open"),
    ).filter("_start is not null and (_open or _end >= _start)")
    # At most one row per record, start, end and openness crosses the shuffle, however often a record repeats them.
    entries = entries.withColumn("_end", F.when(~F.col("_open"), F.col("_end"))).distinct()
    dated = entries.join(seen, "raw_id", "left")
    merged = merge_intervals(dated, "raw_id", F.col("_start"), F.when(F.col("_open"), F.col("_seen")).otherwise(F.col("_end")))
    return merged.select("raw_id", "kind", month_text(F.col("first")).alias("first_month"), month_text(F.col("last")).alias("last_month"))
