"""Two-pass external shuffle into shards.

Pass 1 scatters every record uniformly, by a seeded hash, into buckets that
fit in memory. Pass 2 Fisher-Yates shuffles each bucket. Bucket after bucket
this is one random permutation of all records, and a shard is a contiguous
range of it, so that shard counts differ by one at most (law `rows`).

The hash takes the record's place in its input partition besides doc_id, so
repeated rows and copies spread over all buckets. Cases: null text counts as
empty (size 8); null doc_id, repeated rows and extra columns stay as they are;
an empty table gives no rows. The input must give the same rows in the same
places when it is read again; a bucket whose count has changed between the
passes (as after a lost executor, with an input without fixed order) fails the
job instead of giving wrong slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import docs_of, free

#: A bucket is a share of an executor's memory, within these bounds.
LEAST_BYTES, MOST_BYTES, SHARE = 24 << 20, 512 << 20, 48
_KEY, _BUCKET = "__place", "__bucket"


def bucket_size(spark: SparkSession) -> int:
    """Bytes of a bucket: a SHARE-th of spark.executor.memory."""
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    memory = spark.sparkContext.getConf().get("spark.executor.memory", "1g").lower().rstrip("b")
    n = int(memory[:-1]) * units[memory[-1]] if memory[-1] in units else int(memory) << 20
    return max(LEAST_BYTES, min(MOST_BYTES, n // SHARE))


def external_shuffle(df: DataFrame, n_shards: int, seed: int = 17, text: str = "text", key: str = "doc_id", bucket_bytes: int | None = None) -> DataFrame:
    """df's columns with shard (int) and slot (long); both are overwritten if df has them."""
    df = df.drop("shard", "slot")
    place, bucket = free(df, _KEY, _BUCKET)
    bucket_bytes = bucket_bytes or bucket_size(df.sparkSession)
    total = df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64)), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-int(total) // bucket_bytes))
    place_of = F.monotonically_increasing_id()
    placed = df.withColumn(place, place_of).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(place)), F.lit(n)).cast("int"))
    counts = placed.select(bucket).groupBy(bucket).count().collect()  # one row for each bucket
    size = np.zeros(n, np.int64)
    for r in counts:
        size[r[0]] = r[1]
    start = np.concatenate([[0], np.cumsum(size)])
    rows = int(start[-1])
    edges = np.array([s * rows // n_shards for s in range(n_shards + 1)], np.int64)
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffle(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        k = table.column(bucket)[0].as_py()
        if table.num_rows != size[k]:
            raise RuntimeError(f"bucket {k} has {table.num_rows} rows, {size[k]} when they were counted: the input changed between the passes")
        table = table.take(np.argsort(table.column(place).to_numpy(), kind="stable"))  # the fetch order of a shuffle isn't fixed
        order = np.arange(table.num_rows)
        np.random.default_rng([seed, k]).shuffle(order)  # Fisher-Yates
        at = start[k] + np.arange(len(order))
        shard = np.searchsorted(edges, at, side="right") - 1
        out = table.take(order).drop_columns([place, bucket])
        out = out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(at - edges[shard]))
        yield from out.to_batches(max_chunksize=2000)

    return placed.repartitionById(n, F.col(bucket)).mapInArrow(shuffle, schema)


def write_shards(df: DataFrame, path: str, n_shards: int, **options) -> None:
    """The shuffled records as files of path/shard=N."""
    external_shuffle(df, n_shards, **options).write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = external_shuffle(docs_of(spark, sf_dir), 24)
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffled.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
