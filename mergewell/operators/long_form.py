"""The merge's group operators on long tables, one row per value, for entities of any size.

Everything is a two-step aggregate: first per (entity, key), which the map side combines, then per entity over the distinct keys. No
group is gathered, so a hot entity costs what its distinct values cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mergewell import fixed
from mergewell.settings import Settings


def resolve(df: DataFrame, entity: list[str], value: Column, key: Column, order: list[Column], carry: dict[str, Column]) -> DataFrame:
    """(entity..., value, carried..., agreed, n_values, had_conflict): the first value by ``order`` per entity; null values are left out.

    agreed: rows with the winner's key; n_values: different keys; had_conflict: there are several. order must be total for a stable result.
    """
    rows = df.select(*entity, value.alias("_v"), key.alias("_k"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("_o"), F.struct(*(c.alias(n) for n, c in carry.items())).alias("_c")).filter("_v is not null")
    by_key = rows.groupBy(*entity, "_k").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_o", "_v", "_c")).alias("_f"))
    first = by_key.groupBy(*entity).agg(F.min(F.struct("_f", "_n")).alias("_w"), F.count(F.lit(1)).alias("n_values"), F.sum("_n").alias("n_rows"))
    return first.select(
        *entity, F.col("_w._f._v").alias("value"), *(F.col(f"_w._f._c.{n}").alias(n) for n in carry), F.col("_w._n").alias("agreed"), "n_values", "n_rows", (F.col("n_values") > 1).alias("had_conflict")
    )


def union_distinct(df: DataFrame, entity: list[str], key: Column, order: list[Column], carry: dict[str, Column]) -> DataFrame:
    """(entity..., key, carried..., repeats, rank): the first row of each key of an entity, by ``order``, and how often the key came again."""
    rows = df.select(*entity, key.alias("key"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("_o"), F.struct(*(c.alias(n) for n, c in carry.items())).alias("_c")).filter("key is not null")
    kept = rows.groupBy(*entity, "key").agg(F.min(F.struct("_o", "_c")).alias("_f"), (F.count(F.lit(1)) - 1).alias("repeats"))
    w = Window.partitionBy(*entity).orderBy("_f._o")
    return kept.withColumn("rank", F.row_number().over(w)).select(*entity, "key", *(F.col(f"_f._c.{n}").alias(n) for n in carry), "repeats", "rank")


def places(normalized: DataFrame) -> DataFrame:
    """(entity_id, country_code, city, raw) of the entities with a country, as the merge has them: the country of the first record with one, the city of
    the last record in it, the text of the first record. normalized: normalized records (merge.normalize_records).
    """
    order = F.struct("priority", "source", "rec_seq", "source_file", F.col("location").alias("n"), "city", "place")
    rows = normalized.select("entity_id", F.col("location.value").alias("_k"), order.alias("_o"))
    by_key = rows.groupBy("entity_id", "_k").agg(F.min("_o").alias("_f"), F.max(F.when(F.col("_o.city").isNotNull(), F.col("_o"))).alias("_l"))
    won = F.min(F.when(F.col("_k").isNotNull(), F.struct("_f", "_k", "_l")))
    first = by_key.groupBy("entity_id").agg(won.alias("_w"), F.min("_f").alias("_r")).filter("_w is not null")
    return first.select("entity_id", F.col("_w._k").alias("country_code"), F.col("_w._l.city").alias("city"), F.col("_r.place").alias("raw"))


def interval_union_years(df: DataFrame, entity: str, start: Column, end: Column) -> DataFrame:
    """(entity, years): sum over the united intervals (dates) of the difference of calendar years; entities with 0 are left out.

    Intervals unite where one starts no later than those before it end. Of intervals with one start only the longest
    counts, so a hot entity is cut down on the map side to its distinct starts.
    """
    rows = df.select(F.col(entity).alias("_e"), start.alias("_s"), end.alias("_t")).filter("_s is not null and _t >= _s").groupBy("_e", "_s").agg(F.max("_t").alias("_t"))
    w = Window.partitionBy("_e").orderBy("_s")
    fresh = F.when(F.col("_s") <= F.max("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    islands = rows.withColumn("_f", fresh).withColumn("_n", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("_e", "_n").agg(F.min("_s").alias("_s"), F.max("_t").alias("_t"))
    total = spans.groupBy("_e").agg(F.sum(F.year("_t") - F.year("_s")).alias("years"))
    return total.filter("years > 0").select(F.col("_e").alias(entity), F.col("years").cast("long").alias("years"))


def bonus(agreed: Column, settings: Settings = Settings()) -> Column:
    """What the agreement of so many sources multiplies a score by."""
    step, cap = F.lit(settings.corroboration_bonus).cast("decimal(4,3)"), F.lit(settings.corroboration_cap).cast("decimal(8,4)")
    return F.least((1 + F.greatest(agreed - 1, F.lit(0)).cast("decimal(6,0)") * step).cast("decimal(8,4)"), cap)


def score(rel: Column, factor: Column, agreed: Column, settings: Settings = Settings()) -> Column:
    """reliability x factor x corroboration bonus, at most 1, to four places; the merge of whole entities scores by it, too."""
    product = (rel.cast("decimal(3,2)") * factor.cast("decimal(4,3)") * bonus(agreed, settings)).cast("decimal(20,9)")
    return F.round(F.least(product, F.lit(1).cast("decimal(20,9)")), 4).cast("decimal(6,4)")


def overall(df: DataFrame, entity: list[str]) -> DataFrame:
    """(entity..., overall): mean of the scores above 0 of (entity..., field, score), weighted by field; 0 for none."""
    weights = F.create_map(*(F.lit(x) for f, w in fixed.FIELD_WEIGHTS.items() for x in (f, w)))
    weight = F.coalesce(F.try_element_at(weights, F.col("field")), F.lit("1.0")).cast("decimal(3,1)")
    used = F.col("score") > 0
    total, mass = F.sum(F.when(used, F.col("score") * weight)), F.sum(F.when(used, weight))
    return df.groupBy(*entity).agg(F.coalesce(F.round(total / mass, 4), F.lit(0)).cast("decimal(6,4)").alias("overall"))
