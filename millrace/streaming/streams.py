"""Logs as streams: file source, keyed order, partition ranges, reporting intervals, compaction."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from millrace.operators.timeseries import tumbling_rate


def read_log(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, from its earliest file."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there and stop; a batch is committed after `each` returned (at least once)."""
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def close_log(spark: SparkSession, path: str, time: str, seconds: int, lateness: str) -> None:
    """Append one row that is later than all others by an interval and the lateness, so that every interval with rows closes; its own never does."""
    log = spark.read.parquet(path)
    last = log.agg(F.max(time).alias(time)).filter(F.col(time).isNotNull())
    end = last.select(F.expr(f"{time} + INTERVAL {int(seconds) + 1} SECONDS + INTERVAL {lateness}").alias(time))
    end.select(*[F.col(time) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema]).write.mode("append").parquet(path)


def rates_to_folder(stream: DataFrame, time: str, value: str, seconds: int, lateness: str, path: str, checkpoint: str) -> None:
    """Closed reporting intervals appended to a folder; the watermark lets an interval close."""
    rates = tumbling_rate(stream.withWatermark(time, lateness), time, value, seconds)
    rates.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def partition_of(key: Column, partitions: int) -> Column:
    """Partition of a key by Murmur3."""
    return F.pmod(F.hash(key), F.lit(partitions))


def key_shared(df: DataFrame, key: str, order: list[str], consumers: int) -> DataFrame:
    """All messages of a key go to one consumer, in order."""
    return df.withColumn("consumer", partition_of(F.col(key), consumers)).repartition(consumers, "consumer").sortWithinPartitions("consumer", key, *order)


def failover_range(df: DataFrame, key: str, partitions: int, low: int, high: int) -> DataFrame:
    """Messages of the partitions low to high."""
    return df.withColumn("partition", partition_of(F.col(key), partitions)).filter(F.col("partition").between(low, high))


def order_check(sent: DataFrame, received: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, same): whether each key's values arrived in the order they were sent; a missing or extra value is not."""
    nth = lambda df, name: df.select(key, F.col(value).alias(name), F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("_n"))
    both = nth(sent, "_a").join(nth(received, "_b"), [key, "_n"], "full")
    return both.groupBy(key).agg(F.min(F.col("_a").eqNullSafe(F.col("_b"))).alias("same"))


def sequential_register(history: DataFrame, key: str, order: str) -> DataFrame:
    """(key, valid): whether reads, writes and compare-and-sets of a register agree with each other in order.

    history has op (read, write, cas), value and, for cas, expected. A read must see the last value,
    a cas must find what it expects. The last value before a row is the last written one.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("op") != "read", F.struct("value")), ignorenulls=True).over(w)
    rows = history.withColumn("_before", before["value"])
    ok = F.when(F.col("op") == "read", F.col("value").eqNullSafe(F.col("_before"))).when(F.col("op") == "cas", F.col("expected").eqNullSafe(F.col("_before"))).otherwise(True)
    return rows.groupBy(key).agg(F.min(ok).alias("valid"))


def linearizable_register(history: DataFrame, key: str) -> DataFrame:
    """(key, valid): whether concurrent reads, writes and compare-and-sets of a register can have taken effect one by one, each between its start and its end.

    history: op (read, write, cas), value, expected (for cas), start, end; a null end is an operation
    whose outcome is unknown: it may take effect at any time after its start, or never. A cas that
    returned found what it expects. The register begins with null. Deciding this needs all
    operations of a key together; the search goes depth first and visits no state twice.
    """
    together = history.groupBy(key).agg(F.collect_list(F.struct("op", "value", "expected", "start", "end")).alias("ops"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid = [_linearizable([tuple(o.values()) for o in ops]) for ops in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(valid, pa.bool_())], names=[key, "valid"])

    return together.mapInArrow(check, f"{key} {dict(history.dtypes)[key]}, valid boolean")


def _linearizable(ops: list[tuple]) -> bool:
    """Whether operations (op, value, expected, start, end) have an order that explains all of them."""
    must = frozenset(i for i, o in enumerate(ops) if o[4] is not None)
    seen, todo = set(), [(frozenset(), None)]
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        done, now = state
        if must <= done:
            return True
        # nothing can take effect after the end of an operation that hasn't
        limit = min(ops[i][4] for i in must - done)
        for i, (op, value, expected, start, _) in enumerate(ops):
            if i in done or start > limit:
                continue
            if op == "write" or (op == "cas" and expected == now):
                todo.append((done | {i}, value))
            elif op == "read" and value == now:
                todo.append((done | {i}, now))
    return False


def compact(path: str, spark: SparkSession, group: Callable[[DataFrame], DataFrame], fanout: int = 2) -> None:
    """Merge segments of one schema like a counter of base `fanout`: so many segments of a level become one of the next.

    group gets the rows of all segments that are merged on a level, with the column `segment` that tells
    the new segment; if it keeps that column it is called once a level, else once a new segment. A
    level is merged in one job. The merged segments count from the moment the list of segments names
    them instead of their sources; a failure before leaves the old list, one after it only files that
    nobody reads.
    """
    level = 0
    while True:
        segments = _listed(spark, path)
        own = [s for s in segments if s[0] == level]
        if not own:
            if not any(s[0] > level for s in segments):
                return
        elif len(own) >= fanout:
            groups = [own[i : i + fanout] for i in range(0, len(own) // fanout * fanout, fanout)]
            first = 1 + max((s[1] for s in segments if s[0] == level + 1), default=-1)
            made = [(level + 1, first + i) for i in range(len(groups))]
            to = F.create_map(*[F.lit(x) for g, (_, n) in zip(groups, made, strict=True) for s in g for x in (s[1], n)])
            rows = _read(spark, path, [s for g in groups for s in g], numbered=True).withColumn("segment", to[F.col("segment")])
            merged = group(rows)
            if "segment" not in merged.columns:
                parts = [group(rows.filter(F.col("segment") == n).drop("segment")).withColumn("segment", F.lit(n)) for _, n in made]
                merged = reduce(DataFrame.unionByName, parts)
            _write_segments(merged, path, level + 1)
            gone = [s for g in groups for s in g]
            _list(spark, path, [s for s in segments if s not in gone] + made)
            fs, root = _files(spark, path)
            for s in gone:
                fs.delete(root(_folder(s)), True)
        level += 1


def add_segment(df: DataFrame, path: str) -> None:
    """Write a new segment of level 0."""
    add_segments(df.withColumn("segment", F.lit(0)), path, 1)


def add_segments(df: DataFrame, path: str, n: int) -> None:
    """Write n new segments of level 0; the column `segment` has their numbers from 0 on."""
    spark = df.sparkSession
    segments = _listed(spark, path)
    first = 1 + max((s[1] for s in segments if s[0] == 0), default=-1)
    _write_segments(df.withColumn("segment", F.col("segment") + first), path, 0)
    _list(spark, path, segments + [(0, first + i) for i in range(n)])


def segments_by_size(df: DataFrame, id: str, size: Column, bound: int) -> tuple[Column, int]:
    """(the segment of a row, number of segments): rows go by a hash of their id to as many segments as keep each at about `bound` of `size`."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-total // bound))
    return F.pmod(F.xxhash64(id), F.lit(n)).cast("int"), n


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _listed(spark, path))


def _folder(segment: tuple[int, int]) -> str:
    return f"level={segment[0]}/segment={segment[1]}"


def _read(spark: SparkSession, path: str, segments: list[tuple[int, int]], numbered: bool = False) -> DataFrame:
    """The rows of segments; numbered: with `segment`."""
    # a segment without rows has no files
    fs, root = _files(spark, path)
    there = [root(_folder(s)) for s in segments]
    there = [p.toString() for p in there if fs.exists(p)]
    schema = spark.read.parquet(f"{path}.schema").schema
    if not there:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("segment", F.lit(0)) if numbered else empty
    rows = spark.read.option("basePath", path).schema(schema.add("level", IntegerType()).add("segment", IntegerType())).parquet(*there)
    return rows.drop("level") if numbered else rows.drop("level", "segment")


def _write_segments(df: DataFrame, path: str, level: int) -> None:
    fs, root = _files(df.sparkSession, f"{path}.schema")
    if not fs.exists(root("")):
        df.drop("segment").limit(0).write.mode("overwrite").parquet(f"{path}.schema")
    df.repartition("segment").write.mode("append").partitionBy("segment").parquet(f"{path}/level={level}")


def _listed(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The segments that count: those of the latest list beside the folder."""
    fs, root = _files(spark, f"{path}.lists")
    if not fs.exists(root("")):
        return []
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(root("")) if f.getPath().getName().isdigit()]
    if not numbers:
        return []
    rows = spark.read.json(f"{path}.lists/{max(numbers)}", schema="level int, segment int").collect()
    return sorted((r.level, r.segment) for r in rows)


def _list(spark: SparkSession, path: str, segments: list[tuple[int, int]]) -> None:
    """Name the segments that count. A list is written aside and appears under the next number by one renaming."""
    fs, root = _files(spark, f"{path}.lists")
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(root("")) if f.getPath().getName().isdigit()] if fs.exists(root("")) else []
    aside, to = root("aside"), root(str(1 + max(numbers, default=0)))
    spark.createDataFrame(segments, "level int, segment int").coalesce(1).write.mode("overwrite").json(aside.toString())
    if not fs.rename(aside, to):
        raise OSError(f"can't name the segments of {path}")
    for n in numbers:
        fs.delete(root(str(n)), True)


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    return base.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: jvm.org.apache.hadoop.fs.Path(base, name) if name else base


def keyed_sink(stream: DataFrame, key: str, partitions: int, path: str, checkpoint: str, acknowledged: Callable[[int, int], None] | None = None) -> None:
    """Send each message to the folder of its key's partition; a batch counts as sent when all of it is written.

    A batch that is sent again after a failure replaces what it wrote before. acknowledged(batch, rows)
    is called after each batch.
    """

    def send(df: DataFrame, number: int) -> None:
        placed = df.withColumn("partition", partition_of(F.col(key), partitions)).repartition("partition")
        placed.write.mode("overwrite").partitionBy("partition").parquet(f"{path}/batch={number}")
        if acknowledged:
            acknowledged(number, df.sparkSession.read.parquet(f"{path}/batch={number}").count())

    run_available(stream, checkpoint, send)


def produce(spark: SparkSession, per_second: int, rows: int, path: str, checkpoint: str, seconds: float | None = None) -> None:
    """Write numbered messages (key, value, timestamp) at a rate to a folder until there are `rows` of them or `seconds` are over; keys are value % 1000."""
    end = None if seconds is None else time.monotonic() + seconds
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    messages = rate.select((F.col("value") % 1000).cast("string").alias("key"), "value", "timestamp")
    q = messages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    try:
        while q.isActive and sum(p["numInputRows"] for p in q.recentProgress) < rows and (end is None or time.monotonic() < end):
            q.awaitTermination(1)
    finally:
        q.stop()
