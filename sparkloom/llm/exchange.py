"""How the operators move packed numpy rows between tasks, and where they cut lineage."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import text as T

PACKED = "bucket int, origin long, payload binary"


def partitions(spark: SparkSession) -> int:
    tuned(spark)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session on one machine (tests) gets a fresh local one where that
    is unset; on a cluster each executor would write to its own disk, so there it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tuned(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows: documents are long, and Spark bounds batches by rows alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


BATCH_ROWS = 1000


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkloom_path = path
    return out


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by `written` that no later step reads."""
    for t in tables:
        _delete(t.sparkSession, t._sparkloom_path)


def release(spark: SparkSession) -> None:
    """Delete the tables of this application, once no result reads them any more."""
    _delete(spark, f"{shared_folder(spark)}/sparkloom/{spark.sparkContext.applicationId}")


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`f`, whose worker gives the memory of its temporary arrays back when a task ends: idle workers stay, and an
    executor has several."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_keys: dict[int, list[int]] = {}


def one_key_a_partition(spark: SparkSession, n: int) -> list[int]:
    """Integers, the i-th of which a hash partitioning on n partitions sends to partition i."""
    if n not in _keys:
        _keys[n] = _one_key_a_partition(spark, n)
    return _keys[n]


def _one_key_a_partition(spark: SparkSession, n: int) -> list[int]:
    found: dict[int, int] = {}
    size = 16 * n
    while len(found) < n:
        rows = spark.range(size).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()
        found = {r["p"]: r["k"] for r in rows}
        size *= 4
    return [found[i] for i in range(n)]


def packed(bucket: np.ndarray, rows: np.ndarray, origin: int) -> pa.RecordBatch:
    """One row a bucket: its structured rows in the order given, as bytes."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    rows = rows[order]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    offs = np.concatenate((cut, [len(b)])) * rows.dtype.itemsize if len(b) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(b[cut].astype(np.int32)), pa.array(np.full(len(cut), origin, np.int64)), T.binary(rows, offs)], names=["bucket", "origin", "payload"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows that come sorted by bucket: each bucket's origins and payloads."""
    now, origins, payloads = None, [], []
    for batch in batches:
        for b, o, p in zip(batch.column("bucket").to_pylist(), batch.column("origin").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if b != now:
                if payloads:
                    yield now, origins, payloads
                now, origins, payloads = b, [], []
            origins.append(o)
            payloads.append(p)
    if payloads:
        yield now, origins, payloads


def buckets(spark: SparkSession) -> int:
    """Buckets of a packed exchange: the same number in each partition, 64 at least. A block sends one row
    to each, so there are no more of them than it takes."""
    n = partitions(spark)
    return n * -(-64 // n)


def exchanged(df: DataFrame, reduce: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Send packed rows to their bucket's task; `reduce` sees them sorted by bucket."""
    spark = df.sparkSession
    n = partitions(spark)
    home = F.element_at(F.lit(one_key_a_partition(spark, n)), F.pmod("bucket", F.lit(n)) + 1)
    return df.withColumn("__home", home).repartition(n, "__home").drop("__home").sortWithinPartitions("bucket", "origin").mapInArrow(trimmed(reduce), schema)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rebatched(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, so that what is sent to many blocks isn't cut too small."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([h.column(i) for h in held]) for i in range(held[0].num_columns)], schema=held[0].schema)

    for batch in batches:
        if held and size + batch.nbytes > most:
            yield joined()
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield joined()


def blocks(docs: DataFrame, block: Column, n: int) -> DataFrame:
    """PACKED rows (origin 1) of compressed runs of `docs` by block, to be sent to their block's task. `block` (a
    long) must depend on a row's content alone, so that the same rows meet again in every pass."""
    spark = docs.sparkSession
    keys = np.array(one_key_a_partition(spark, n), np.int32)
    wide = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in rebatched(batches):
            where = batch.column(wide).to_numpy()
            order = np.argsort(where, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], np.diff(where[order]) > 0, [True]))) if len(where) else [0]
            rows = batch.select(list(range(wide))).take(pa.array(order))
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in rows.slice(a, b - a).columns], schema=rows.schema))
                out.append(sink.getvalue().to_pybytes())
            there = [int(where[order[a]]) for a in cut[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[there] if there else [], pa.int32()), pa.array([1] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["bucket", "origin", "payload"])

    return docs.select("*", F.pmod(block, F.lit(n)).cast("int").alias(unused(docs, "block"))).mapInArrow(trimmed(run), PACKED)


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose long `key` isn't among the first column of `gone`. Rows travel once, compressed, to
    their block, and the ids meet them there; a null key stays."""
    spark = docs.sparkSession
    n = partitions(spark)
    keys = np.array(one_key_a_partition(spark, n), np.int32)
    at = lambda c: F.xxhash64(c.cast("long"))
    put = docs.select("*", F.col(key).cast("long").alias(unused(docs, "id")))
    # rows without an id are dealt by their order, as nothing has to meet them
    texts = blocks(put, F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(at(F.col(key))), n)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, home = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield packed(keys[home].astype(np.int64), ids.view(np.dtype([("id", "<i8")])), -1)

    id_ = gone.columns[0]
    ids = gone.filter(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.pmod(at(F.col(id_)), F.lit(n)).cast("int").alias("home")).mapInArrow(trimmed(send), PACKED)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, out = [], None
        for batch in batches:
            for o, p in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if o < 0:
                    parts.append(np.frombuffer(p.as_py(), np.int64))
                    continue
                if out is None:
                    out = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                rows = unblocked(p.as_py())
                own = rows.column(len(names))
                hit = np.isin(own.fill_null(0).to_numpy(zero_copy_only=False), out) & ~own.is_null().to_numpy(zero_copy_only=False)
                yield rows.select(list(range(len(names)))).filter(pa.array(~hit))

    return ids.unionByName(texts).repartition(n, "bucket").sortWithinPartitions("bucket", "origin").mapInArrow(trimmed(keep), docs.schema)


def unblocked(payload: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(payload)))


#: Size of a membership filter: a constant, 1 MB.
BLOOM_BITS = 23


def bloom(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size that holds the longs of column `id`; full for very many, and then of no
    help, but never wrong."""

    def spots(v: np.ndarray) -> np.ndarray:
        h = T.mix(v.view(np.uint64))
        return np.concatenate([(h >> np.uint64(k * 20)) & np.uint64((1 << BLOOM_BITS) - 1) for k in range(3)]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            bits[spots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))] = True
        b = np.packbits(bits)
        if b.any():
            yield packed(np.arange(len(b)) // (len(b) // 16), b.view(np.dtype([("b", "u1")])), 0)

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, _, payloads in by_bucket(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in payloads]).tobytes()], pa.binary())], names=["bucket", "payload"])

    out = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    step = len(out) // 16
    for r in exchanged(ids.select(F.col("id").cast("long")).mapInArrow(trimmed(run), PACKED), either, "bucket int, payload binary").collect():
        out[r.bucket * step : (r.bucket + 1) * step] = np.frombuffer(r.payload, np.uint8)
    return out


def maybe_in(bits: np.ndarray, v: np.ndarray) -> np.ndarray:
    h, out = T.mix(v.view(np.uint64)), np.ones(len(v), bool)
    for k in range(3):
        s = ((h >> np.uint64(k * 20)) & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)
        out &= (bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
    return out
