"""Tolerant readers and idempotent writers of append-only logs and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl(spark: SparkSession, path: str, schema: T.StructType, keep: Column | None = None) -> DataFrame:
    """Rows of a JSON-lines folder or file. Blank and broken lines are skipped; a path without files gives no
    rows; `keep` is a further condition, say on a schema id."""
    wide = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    try:
        rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.col("_broken").isNull() & F.coalesce(*(F.col(f.name).isNotNull() for f in schema.fields[:1]))).drop("_broken")
    return rows if keep is None else rows.filter(keep)


def fixture(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Graded queries: a JSON list, an object with `queries`, or JSON lines."""
    inner = T.ArrayType(schema)
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", inner)
    held = F.from_json("value", T.StructType([T.StructField("queries", inner)]))["queries"]
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, schema))
    first = F.substring(F.ltrim("value"), 1, 1)
    rows = F.when(first == "[", listed).when(F.col("value").rlike(r'^\s*\{\s*"queries"'), held).otherwise(lines)
    return text.select(F.explode(rows).alias("q")).select("q.*")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, section, body) of each second-level section of the Markdown files below a folder. Text in
    fences doesn't start a section."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    body = F.regexp_replace("text", r"^---\n[\s\S]*?\n---\n", "")
    lines = files.select("path", F.posexplode(F.split(body, "\n")).alias("n", "line"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fenced = F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(w) % 2 == 1
    marked = lines.withColumn("fenced", fenced).withColumn("head", ~F.col("fenced") & F.col("line").rlike(r"^##\s+"))
    marked = marked.withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    out = marked.groupBy("path", "section").agg(F.max(F.when(F.col("head"), F.regexp_replace("line", r"^##\s+", ""))).alias("title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return out.filter(F.trim("body") != "")


def front_matter(text: Column) -> Column:
    """Scalar fields of a leading `---` block as a map; null without one."""
    block = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---(?:\n|$)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:"))
    key = lambda x: F.regexp_extract(x, r"^([A-Za-z_][A-Za-z0-9_]*):", 1)
    value = lambda x: F.nullif(F.regexp_replace(F.regexp_extract(x, r"^[^:]*:\s*(.*?)\s*$", 1), r'^"(.*)"$', "$1"), F.lit("null"))
    return F.when(text.rlike(r"^---\n[\s\S]*?\n---(\n|$)"), F.map_from_entries(F.transform(pairs, lambda x: F.struct(key(x), value(x)))))


def append(rows: DataFrame, paths: list[str], by: list[str] | None = None) -> None:
    """The same rows to each log, in folders by the columns `by`."""
    for path in paths:
        out = rows.write.mode("append")
        (out.partitionBy(*by) if by else out).json(path)


def log_rows(spark: SparkSession, path: str, schema: T.StructType, schema_id: str, field: str, values: list[str]) -> DataFrame:
    """Rows of a log that carry its schema id and an allowed value."""
    return jsonl(spark, path, schema, (F.col("schema_id") == schema_id) & F.col(field).isin(values))


def upserted(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of both, the last version of each key; of equal versions the new row, and of equal new rows that with the
    largest content."""
    every = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    content = F.to_json(F.struct(*sorted(set(every.columns) - {"__new"})))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last(version), F.desc("__new"), F.desc(content)))
    return every.withColumn("__n", n).filter("__n = 1").drop("__n", "__new")
