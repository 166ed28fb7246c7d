"""Streaming jobs, each drained over the table's rows in several micro-batches and compared with its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import cache, groups, incremental, scans
from shelfwise.plans.asset_queries import _ROLLS
from shelfwise.plans.pair_queries import _NEAR, _SIMILAR, _items
from shelfwise.plans.registry import query
from shelfwise.plans.signal_queries import _NEW, _UPSERT, _new_signals, _rounded
from shelfwise.session import drop, settle, shared_dir
from shelfwise.sources.adapters import Tables
from shelfwise.streaming import jobs

FILES = 4


def _stream(t: Tables, rows: DataFrame, order: str, far: int = 0) -> tuple[DataFrame, str]:
    """The rows as files that arrive one after another, each its own micro-batch, and a folder for the job.

    ``far`` more files hold one row a library, each 400 days on, so that the watermark passes all before.
    """
    path = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    parts = settle(rows.repartitionByRange(FILES, order).withColumn("part", F.spark_partition_id()), "arrivals")
    for k in range(FILES):
        parts.where(F.col("part") == k).drop("part").sortWithinPartitions(order).coalesce(1).write.mode("append").parquet(f"{path}/in")
    last = rows.groupBy("library_id").agg(F.max(order).alias("last")) if far else None
    for k in range(1, far + 1):
        ahead = {order: F.col("last") + F.expr(f"interval '{400 * k}' day"), "library_id": F.col("library_id")}
        last.select(*[ahead.get(c, F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    drop(parts)
    return jobs.source(t.spark, f"{path}/in", rows, 1), path


def _before(rows: DataFrame, t: Tables) -> DataFrame:
    """Without what the far rows gave."""
    return rows.join(t.assets.groupBy("library_id").agg(F.max("creation_date").alias("last")), "library_id").where("start_at <= last").drop("last")


@query("select library_id, sum(bytes)::bigint as bytes, sum(n)::bigint as n from deletions group by 1")
def stream_bytes_freed(t: Tables) -> DataFrame:
    stream, path = _stream(t, t.deletions, "ts")
    return jobs.drain(jobs.bytes_freed(stream), path, ["library_id"])


@query("select library_id, reason, count(*) as n from deletions group by 1, 2")
def stream_affinity(t: Tables) -> DataFrame:
    stream, path = _stream(t, t.deletions, "ts")
    return jobs.drain(jobs.affinity(stream), path, ["library_id", "reason"])


@query("select library_id, time_bucket(interval '15 minutes', creation_date) as start_at, count(*) as n from assets group by 1, 2")
def stream_windowed_intake(t: Tables) -> DataFrame:
    stream, path = _stream(t, t.assets.select("library_id", "creation_date"), "creation_date", 2)
    return _before(jobs.drain(jobs.windowed_intake(stream), path), t)


@query("with s as (select *, case when epoch_us(creation_date) - lag(epoch_us(creation_date)) over w <= 1800000000 then 0 else 1 end as f from assets window w as (partition by library_id order by creation_date, asset_id)), x as (select *, sum(f) over (partition by library_id order by creation_date, asset_id rows unbounded preceding) as session from s) select library_id, min(creation_date) as start_at, max(creation_date) as end_at, count(*) as n from x group by library_id, session")
def stream_event_sessions(t: Tables) -> DataFrame:
    stream, path = _stream(t, t.assets.select("library_id", "creation_date"), "creation_date", 2)
    return _before(jobs.drain(jobs.event_sessions(stream), path), t)


@query(_ROLLS + "select library_id, members, start_at, end_at, n, lat, lon from rolls")
def stream_event_rolls(t: Tables) -> DataFrame:
    rows = scans.images(t.assets, True).select("library_id", "asset_id", "creation_date", "latitude", "longitude")
    stream, path = _stream(t, rows, "creation_date", 2)
    return jobs.drain(jobs.event_rolls(stream), path)


@query("select library_id, dhash, list(asset_id order by asset_id) as members from dhashes join assets using (asset_id, library_id) where media_type = 'image' group by 1, 2 having count(*) >= 2")
def stream_exact_duplicates(t: Tables) -> DataFrame:
    rows = scans.images(t.assets, True).select("library_id", "asset_id", "creation_date").join(t.dhashes.select("asset_id", "dhash"), "asset_id")
    stream, path = _stream(t, rows.select("library_id", "asset_id", "dhash"), "asset_id")
    blocks = jobs.drain(jobs.exact_duplicates(stream), path, ["library_id", "dhash", "block"])
    return blocks.groupBy("library_id", "dhash").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("members")).where("size(members) >= 2")


@query(f"with {_NEW} {_UPSERT}")
def stream_cache_upsert(t: Tables) -> DataFrame:
    stream, path = _stream(t, _new_signals(t), "asset_id")
    jobs.cache_upsert(stream, path).awaitTermination()
    arrived = jobs.current(t.spark, path, jobs.SIGNALS, ["asset_id"])
    return _rounded(cache.upsert(t.asset_analysis, arrived))


@query("select library_id, count(*) as n from assets group by 1")
def stream_new_assets(t: Tables) -> DataFrame:
    stream, path = _stream(t, t.assets.select("library_id", "asset_id"), "asset_id")
    return jobs.drain(jobs.new_assets(stream), path, ["library_id"])


@query(_NEAR)
def stream_near_groups(t: Tables) -> DataFrame:
    """Near groups of prints that arrive in four batches, out of order of time and id."""
    stream, path = _stream(t, t.feature_prints.withColumn("turn", F.xxhash64("asset_id")), "turn")
    jobs.near_groups(stream, path).awaitTermination()
    found = incremental.labels(t.spark, path)
    return groups.near_groups_of(_items(t), found, t.feature_prints.select("asset_id", "vec")).select("library_id", "group_id", "reason", "similarity", "members")


@query(_SIMILAR)
def stream_similar_groups(t: Tables) -> DataFrame:
    """Similar groups of prints that arrive in four batches, out of order of time and id."""
    stream, path = _stream(t, t.feature_prints.withColumn("turn", F.xxhash64("asset_id")), "turn")
    jobs.similar_groups(stream, path).awaitTermination()
    return groups.similar_groups_of(_items(t), incremental.labels(t.spark, path)).select("library_id", "group_id", "reason", "members")
