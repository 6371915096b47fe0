"""Two-pass external shuffle into shards.

Pass one scatters the records by a seeded hash over buckets of about `bucket_bytes` bytes, in
two levels: buckets are dealt in runs to at most `most_partitions` shuffle partitions, and a
partition's records are sorted by bucket (Spark's external sort, which spills).  Pass two
reads a partition bucket by bucket: it brings a bucket into a fixed order, Fisher-Yates
shuffles it and writes it.  Buckets laid end to end are a uniform random order of all
records, and shard s takes the positions from floor(s*n/k) to floor((s+1)*n/k): row counts
differ by one at most.  A bucket's first position is its partition's, of which the driver
knows one number each, plus the rows of the partition that went before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_path

BUCKET_BYTES = 8 << 20


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A seeded permutation of range(n)."""
    order, rng = np.arange(n), np.random.default_rng(seed)
    swaps = rng.integers(0, np.arange(n, 0, -1)).tolist() if n else []
    out = order.tolist()
    for i, s in enumerate(swaps):
        out[i], out[i + s] = out[i + s], out[i]
    return np.array(out, np.int64)


def bounds(n: int, shards: int) -> list[int]:
    return [s * n // shards for s in range(shards + 1)]


def shuffle_shards(records: DataFrame, shards: int = 8, seed: int = 7, key_cols: tuple[str, ...] = ("doc_id", "text"), text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, most_partitions: int = 2048, hot_rows: int = 10_000, path: str | None = None) -> DataFrame:
    """Write `records` as shuffled shards and return what was written, with _shard, _slot and their columns.

    The order depends on the keys and the seed alone.  Rows with equal keys go to one
    bucket and are interchangeable; those of a key with more than `hot_rows` rows are
    scattered by their place in the input instead.  Columns _shard, _slot and _bucket of
    `records` are replaced.  Nulls are keys like others.  Long texts may make a bucket
    larger than `bucket_bytes`, by one text at most in expectation.  An empty table gives empty shards.  Only
    counts by partition reach the driver.
    """
    spark = records.sparkSession
    records = records.drop("_shard", "_slot", "_bucket")
    keys = list(key_cols)
    own = records.select(F.xxhash64(F.lit(seed), *keys).alias("h"), record_size(F.col(text_col)).alias("b"))
    each = materialize(own.groupBy("h").agg(F.count("*").alias("n"), F.sum("b").alias("b")).groupBy((F.col("n") > hot_rows).alias("hot"), F.when(F.col("n") > hot_rows, F.col("h")).alias("h")).agg(F.sum("b").alias("b")), "key-sizes")
    total = each.agg(F.sum("b")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    run_length = math.ceil(buckets / most_partitions)  # buckets of a partition
    parts = math.ceil(buckets / run_length)
    place = F.xxhash64(F.lit(seed), *keys)
    hot = each.filter("hot").select(F.col("h").alias("_hot"))
    few = hot.count()
    if few:
        # at most a row for each hot_rows rows; only a small table is broadcast
        hot = F.broadcast(hot) if few <= 100_000 else hot
        marked = records.withColumn("_h", place).join(hot, F.col("_h") == F.col("_hot"), "left")
        marked = marked if few <= 100_000 else materialize(marked, "marked")  # rows must keep their places
        records, place = marked.drop("_h"), F.when(F.col("_hot").isNull(), place).otherwise(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    scattered = records.withColumn("_bucket", F.pmod(place, F.lit(buckets)))
    scattered = scattered.drop("_hot") if few else scattered
    part = (F.col("_bucket") / run_length).cast("int")
    counts = np.zeros(parts, np.int64)
    for p, n in scattered.groupBy(part.alias("p")).count().collect():  # at most most_partitions rows
        counts[p] = n
    begins = np.concatenate([[0], np.cumsum(counts)])
    edges = np.array(bounds(int(begins[-1]), shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        at, held, bucket = int(begins[p]), [], None

        def shuffled() -> Iterator[pa.RecordBatch]:
            nonlocal at
            table = pa.Table.from_batches(held).drop_columns(["_bucket"])
            held.clear()
            order = pc.sort_indices(table, sort_keys=[(k, "ascending") for k in keys]).to_numpy()
            order = order[fisher_yates(len(order), (seed, int(bucket)))]
            for k in range(0, len(order), 256):  # a copy of 256 rows at a time
                rows = table.take(pa.array(order[k : k + 256]))
                place = at + k + np.arange(rows.num_rows)
                shard = np.searchsorted(edges, place, side="right") - 1
                yield from rows.append_column("_shard", pa.array(shard.astype(np.int32))).append_column("_slot", pa.array(place - edges[shard])).combine_chunks().to_batches()
            at += len(order)

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("_bucket").to_numpy()
            cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
                if held and names[a] != bucket:
                    yield from shuffled()
                bucket = names[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from shuffled()
        if at != begins[p + 1]:
            raise RuntimeError(f"partition {p} has {at - begins[p]} rows, not {counts[p]}: the input changed between its two reads")

    schema = T.StructType([*records.drop("_hot").schema.fields, T.StructField("_shard", T.IntegerType()), T.StructField("_slot", T.LongType())])
    scattered = scattered.repartitionById(parts, part)
    scattered = scattered.sortWithinPartitions("_bucket") if run_length > 1 else scattered
    path = path or f"{new_path(spark, 'shards')}/t"
    scattered.mapInArrow(run, schema).write.partitionBy("_shard").parquet(path)
    return spark.read.schema(schema).parquet(path)
