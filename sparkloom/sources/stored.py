"""Tables that are derived from other tables once and kept in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a session on one machine gets a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def files_digest(df: DataFrame) -> str:
    """A digest of the names, sizes and times of the files below a table."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = hashlib.sha256()
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        path = hadoop.Path(folder)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        names = {f.rsplit("/", 1)[1] for f in df.inputFiles() if f.rsplit("/", 1)[0] == folder}
        rows = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found)
        out.update(repr([folder, *(r for r in rows if r[0] in names)]).encode())
    return out.hexdigest()[:24]


def stored(source: DataFrame, name: str, version: str, build: Callable[[str], dict[str, str]]) -> str:
    """The folder of what `build` has written for this state of `source` and this version, built if it isn't there.

    A build goes to a folder of its own; its manifest (what it was built from, and what `build` returns) is written last
    and the folder then takes its name, so a build that was cut off is never read, and of two builds at a time one stays."""
    spark = source.sparkSession
    root = f"{shared_folder(spark)}/sparkloom-tables"
    digest = files_digest(source)
    final, fresh = f"{root}/{name}-{version}-{digest}", f"{root}/.{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(final).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(hadoop.Path(f"{final}/manifest/_SUCCESS")):
        return final
    fields = {"name": name, "version": version, "source": digest, **build(fresh)}
    spark.createDataFrame([tuple(fields.values())], ", ".join(f"`{k}` string" for k in fields)).coalesce(1).write.json(f"{fresh}/manifest")
    if not files.exists(hadoop.Path(final)) and files.rename(hadoop.Path(fresh), hadoop.Path(final)):
        return final
    files.delete(hadoop.Path(fresh), True)  # another build was first
    return final


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder as a reliable checkpoint, for results that several others read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
