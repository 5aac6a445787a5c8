"""A keyed table in buckets, with its changes beside it.

Rows lie in buckets by a hash of their key. An upsert writes the new rows, and a deletion the keys, as parts of the buckets that
they fall into; nothing else is written. What belongs to the table is said by its manifest, one small file a version, which
is written last and takes its name at once: a write that is cut off leaves the version before, and of two writers of one
version the second fails. Reading merges the parts of the buckets that have changes, by key, and takes the others as they
are, without a shuffle. `compacted` rewrites the changed buckets alone. Old versions can still be read, and `changes` gives
what came after one.

Of the rows of a key the latest change counts, within a change the highest `version`, then the largest content. Null keys
are a key. An upsert without rows makes no version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET, SEQ, GONE = "__bucket", "__seq", "__gone"


@dataclass
class Table:
    """A version of a table. parts: (bucket, change, folder below the root) in order; change 0 is what a bucket was created or
    compacted with."""

    root: str
    key: list[str]
    version_column: str
    n_buckets: int
    version: int
    columns: str
    parts: list[tuple[int, int, str]]

    def changed(self) -> set[int]:
        return {b for b, change, _ in self.parts if change}


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _publish(spark: SparkSession, table: Table) -> Table:
    files, path = _files(spark, table.root)
    name, draft = path(f"{table.root}/manifests/{table.version:08d}.json"), path(f"{table.root}/manifests/.{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps(table.__dict__).encode()))
    out.close()
    if files.exists(name) or not files.rename(draft, name):
        files.delete(draft, False)
        raise RuntimeError(f"version {table.version} was written by another")
    return table


def opened(spark: SparkSession, root: str, version: int | None = None) -> Table:
    """The last version, or one of a number."""
    files, path = _files(spark, root)
    found = sorted(s.getPath().getName() for s in files.listStatus(path(f"{root}/manifests")) if not s.getPath().getName().startswith("."))
    name = found[-1] if version is None else f"{version:08d}.json"
    text = spark.read.text(f"{root}/manifests/{name}", wholetext=True).first()[0]
    t = Table(**{**json.loads(text), "root": root})
    t.parts = [tuple(p) for p in t.parts]
    return t


def _bucketed(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))


def _written(rows: DataFrame, root: str, n: int) -> dict[int, str]:
    """Write rows that have a bucket; the folder of each bucket that got some."""
    spark = rows.sparkSession
    folder = f"{root}/data/{uuid.uuid4().hex}"
    many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(many, BUCKET).write.partitionBy(BUCKET).parquet(folder)
    files, path = _files(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(path(folder))]
    return {int(x.split("=")[1]): f"{folder.removeprefix(root + '/')}/{x}" for x in names if x.startswith(f"{BUCKET}=")}


def _latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    content = F.to_json(F.struct(*sorted(c for c in rows.columns if not c.startswith("__"))))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(SEQ), F.desc_nulls_last(version), F.desc(content)))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def created(rows: DataFrame, root: str, key: list[str], version: str, n_buckets: int = 64) -> Table:
    """A new table, of the last version of each key."""
    spark = rows.sparkSession
    once = _latest(rows.withColumn(SEQ, F.lit(0)), key, version).drop(SEQ).withColumn(GONE, F.lit(False))
    folders = _written(_bucketed(once, key, n_buckets), root, n_buckets)
    return _publish(spark, Table(root, key, version, n_buckets, 1, rows.schema.json(), [(b, 0, f) for b, f in sorted(folders.items())]))


def upserted(table: Table, rows: DataFrame) -> Table:
    """The next version, with `rows` in place of those of their keys. Only their buckets get a part."""
    return _changed(table, rows.withColumn(GONE, F.lit(False)))


def deleted(table: Table, keys: DataFrame) -> Table:
    """The next version, without the rows of some keys."""
    schema = _schema(table)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in table.key]
    return _changed(table, keys.select(*table.key, *empty).distinct().withColumn(GONE, F.lit(True)))


def _schema(table: Table):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(table.columns))


def _changed(table: Table, rows: DataFrame) -> Table:
    names = [*(f.name for f in _schema(table)), GONE]
    folders = _written(_bucketed(rows.select(*names), table.key, table.n_buckets), table.root, table.n_buckets)
    if not folders:
        return table
    change = table.version + 1
    return _publish(rows.sparkSession, Table(**{**table.__dict__, "version": change, "parts": [*table.parts, *((b, change, f) for b, f in sorted(folders.items()))]}))


def _parts(spark: SparkSession, table: Table, parts: list[tuple[int, int, str]]) -> DataFrame:
    schema = _schema(table).add(GONE, "boolean")
    out = spark.createDataFrame([], schema).withColumn(SEQ, F.lit(0)).withColumn(BUCKET, F.lit(0))
    for change in sorted({c for _, c, _ in parts}):
        folders = [f"{table.root}/{f}" for _, c, f in parts if c == change]
        out = out.unionByName(spark.read.schema(schema).parquet(*folders).withColumn(SEQ, F.lit(change)).withColumn(BUCKET, F.lit(0)))
    return out.drop(BUCKET)


def rows_of(spark: SparkSession, table: Table) -> DataFrame:
    """The table's rows. Buckets without changes are read as they are."""
    names, changed = [f.name for f in _schema(table)], table.changed()
    whole = _parts(spark, table, [p for p in table.parts if p[0] not in changed]).select(*names)
    if not changed:
        return whole
    merged = _latest(_parts(spark, table, [p for p in table.parts if p[0] in changed]), table.key, table.version_column)
    return whole.unionByName(merged.filter(~F.col(GONE)).select(*names))


def compacted(spark: SparkSession, table: Table) -> Table:
    """The next version, in which the changed buckets are one part each; the others' files stay."""
    changed = table.changed()
    if not changed:
        return table
    merged = _latest(_parts(spark, table, [p for p in table.parts if p[0] in changed]), table.key, table.version_column).filter(~F.col(GONE)).drop(SEQ)
    folders = _written(_bucketed(merged, table.key, table.n_buckets), table.root, table.n_buckets)
    parts = [*(p for p in table.parts if p[0] not in changed), *((b, 0, f) for b, f in folders.items())]
    return _publish(spark, Table(**{**table.__dict__, "version": table.version + 1, "parts": sorted(parts)}))


def changes(spark: SparkSession, table: Table, since: int) -> DataFrame:
    """(rows, change, gone): what came after a version, as far as it has not been compacted."""
    return _parts(spark, table, [p for p in table.parts if p[1] > since]).withColumnsRenamed({SEQ: "change", GONE: "gone"})
