"""Serving reads: current objects, histories, lineage, due work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.sources.scratch import stored

MOST_LINEAGE = 200


def object_current(objects: DataFrame, properties: DataFrame, geometries: DataFrame | None = None) -> DataFrame:
    """Objects with a map of their visible properties (empty if none) and, if given, their
    geometry columns. properties: object_id, property, value, already redacted."""
    maps = properties.groupBy("object_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("property", "value")))).alias("properties"))
    out = objects.join(maps, "object_id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))
    return out if geometries is None else out.join(geometries, "object_id", "left")


def object_history(revisions: DataFrame, most: int, as_of: Column | None = None, before: int | None = None) -> DataFrame:
    """Each object's newest revisions, `most` of them, as recorded at a system time and before a
    revision number."""
    rows = revisions
    if as_of is not None:
        rows = rows.filter(F.col("recorded_at") <= as_of)
    if before is not None:
        rows = rows.filter(F.col("revision_no") < before)
    w = Window.partitionBy("object_id").orderBy(F.col("revision_no").desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def lineage(contributions: DataFrame, source_right: Column, raw_right: Column, most: int = MOST_LINEAGE) -> DataFrame:
    """Each object's newest contributions; source and raw reference only where the rights hold."""
    w = Window.partitionBy("object_id").orderBy(F.col("created_at").desc(), "contribution_id")
    rows = contributions.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    return rows.withColumn("source_id", F.when(source_right, F.col("source_id"))).withColumn("raw_ref", F.when(raw_right, F.col("raw_ref")))


def due_jobs(jobs: DataFrame, now: Column, most: int) -> DataFrame:
    """The oldest due jobs: READY, or with a lease that has run out."""
    open_ = (F.col("status") == "READY") | ((F.col("status") == "LEASED") & (F.col("lease_until") <= now))
    return jobs.filter(open_ & (F.col("due_at") <= now)).orderBy("due_at", "job_id").limit(most)


def coverage(tokens: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """One row that an identity index is valid by: the policy's fingerprint, the indexed objects
    and tokens, and a digest of all tokens in which order plays no part."""
    line = F.xxhash64(key, "property", "comparator", "token")
    return tokens.agg(F.lit(fingerprint).alias("policy"), F.count_distinct(key).alias("objects"), F.count(F.lit(1)).alias("tokens"), F.coalesce(F.bit_xor(line), F.lit(0)).alias("digest"))


def percentiles(samples: DataFrame, by: str, value: str, shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Per group the number of samples, their greatest, and nearest-rank percentiles p50, p95 ...

    Distinct values are counted, ordered over all tasks, and ranked by what lies in the tasks before,
    so a group of any size is spread over them. Null samples don't count; a null group is a group."""
    counted = samples.groupBy(F.col(by).alias("_g"), F.col(value).alias("_v")).agg(F.count(value).alias("_n"))
    placed = stored(counted.repartitionByRange("_g", "_v").withColumn("_part", F.spark_partition_id()), "percentiles")
    sums = placed.groupBy("_g", "_part").agg(F.sum("_n").alias("_m"), F.max("_v").alias("_top"))  # a row for each group of a task
    group = Window.partitionBy("_g")
    sums = sums.select("*", F.sum("_m").over(group).alias("n"), F.max("_top").over(group).alias("most"), (F.sum("_m").over(group.orderBy("_part")) - F.col("_m")).alias("_before"))
    sums = sums.select(F.col("_g").alias("_group"), F.col("_part").alias("_at"), "_m", "_before", "n", "most")
    ranks = {f"p{round(100 * s)}": F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("n"))) for s in shares}
    holds = F.lit(False)
    for r in ranks.values():
        holds = holds | (r > F.col("_before")) & (r <= F.col("_before") + F.col("_m"))
    # only where a rank lies are values looked at
    near = placed.join(sums.filter(holds), F.col("_g").eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    near = near.withColumn("_end", F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", "_part").orderBy("_v")))
    found = near.groupBy("_g").agg(*[F.max(F.when((r <= F.col("_end")) & (r > F.col("_end") - F.col("_n")), F.col("_v"))).alias(p) for p, r in ranks.items()])
    totals = sums.groupBy("_group").agg(F.max("n").alias("n"), F.max("most").alias("most"))
    return totals.join(found, F.col("_group").eqNullSafe(F.col("_g")), "left").select(F.col("_group").alias(by), "n", *ranks, "most")


def parked(rows: DataFrame, now: Column, before: Column | None = None) -> DataFrame:
    """rows with state: PARKED until valid_from, then DUE; with `before`, the last tick's time,
    RELEASED are those that became due since."""
    due = F.col("valid_from").isNull() | (F.col("valid_from") <= now)
    fresh = F.lit(False) if before is None else F.coalesce(F.col("valid_from") > before, F.lit(False))
    return rows.withColumn("state", F.when(~due, "PARKED").when(fresh, "RELEASED").otherwise("DUE"))
