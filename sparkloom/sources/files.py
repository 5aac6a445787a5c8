"""Readers of API dumps, traces, cohorts, chunk tables, test reports and Markdown links; index builds with a manifest,
atomic replacement, run logs and rendered packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def api_pages(spark: SparkSession, path: str, item: T.StructType) -> DataFrame:
    """Items of files that hold pages (lists of lists, or one list) of an API's answers, flattened."""
    text = spark.read.text(path, wholetext=True)
    nested, flat = F.from_json("value", T.ArrayType(T.ArrayType(item))), F.from_json("value", T.ArrayType(item))
    inner = F.when(F.col("value").rlike(r"^\s*\[\s*\["), F.flatten(nested)).otherwise(flat)
    return text.select(F.explode(inner).alias("i")).select("i.*")


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a trace; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def cohort(spark: SparkSession, path: str, item: T.StructType, key: str = "query_id") -> DataFrame:
    """Queries of a cohort file {query_count, queries}; their number and the uniqueness of ids are checked, as such a
    file is small."""
    whole = spark.read.schema(T.StructType([T.StructField("query_count", T.LongType()), T.StructField("queries", T.ArrayType(item))])).option("multiLine", True).json(path)
    rows = whole.select(F.explode("queries").alias("q")).select("q.*")
    wanted = whole.agg(F.sum("query_count")).first()[0]
    found, different = rows.agg(F.count("*"), F.countDistinct(key)).first()
    if wanted != found:
        raise ValueError(f"query_count is {wanted}, but there are {found} queries")
    if found != different:
        raise ValueError(f"{found - different} ids of {key} repeat")
    return rows


def legacy_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of an old table in the order of ids, with their JSON list of anchors read; a broken list is empty."""
    anchors = F.coalesce(F.from_json("anchors", "array<string>"), F.array().cast("array<string>"))
    return rows.withColumn("anchors", anchors).orderBy("id")


def junit(spark: SparkSession, path: str) -> DataFrame:
    """One event for each test case of JUnit reports: (suite, name, passed, message)."""
    schema = "_classname string, _name string, failure struct<_message:string,_VALUE:string>, error struct<_message:string,_VALUE:string>, skipped string"
    rows = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    wrong = F.coalesce("failure._message", "failure._VALUE", "error._message", "error._VALUE")
    failed = F.col("failure").isNotNull() | F.col("error").isNotNull()
    return rows.select(F.col("_classname").alias("suite"), F.col("_name").alias("name"), (~failed).alias("passed"), F.when(failed, wrong).alias("message"))


def markdown_links(text: Column) -> Column:
    """Targets of inline links outside fences and inline code."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?ms)^\s*(```|~~~).*?^\s*\1[^\n]*$", ""), r"`[^`\n]*`", "")
    return F.regexp_extract_all(bare, F.lit(r"\[[^\]\n]*\]\(([^)\s]+)\)"), F.lit(1))


def front_matter_lists(text: Column) -> Column:
    """Lists of a leading `---` block, inline ([a, b]) and block (- a), as a map; null without a block."""
    block = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---(?:\n|$)", 1)
    folded = F.regexp_replace(block, r"\n\s*-\s+", "\u0001")  # a block list follows its key
    lines = F.filter(F.split(folded, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:\s*(\[.*\]\s*$|\x01)"))
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"""^["'](.*)["']$""", "$1"), r'\\(["\\])', "$1")

    def values(line: Column) -> Column:
        inline = F.split(F.regexp_extract(line, r"^[^:]*:\s*\[(.*)\]\s*$", 1), ",")
        listed = F.slice(F.split(line, "\u0001"), 2, 1_000_000)
        return F.filter(F.transform(F.when(line.contains("\u0001"), listed).otherwise(inline), clean), lambda x: x != "")

    return F.when(text.rlike(r"^---\n[\s\S]*?\n---(\n|$)"), F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_][A-Za-z0-9_]*):", 1), values(x)))))


def build_index(rows: DataFrame, path: str, manifest: dict[str, str], per_file: int = 1_000_000) -> None:
    """Write an index table and beside it a manifest of one row: what it was built from, and how many rows it has. The
    manifest comes last, so that a build that was cut off has none."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(f"{path}/rows")
    n = spark.read.parquet(f"{path}/rows").count()
    fields = {**manifest, "row_count": str(n)}
    spark.createDataFrame([tuple(fields.values())], ", ".join(f"`{k}` string" for k in fields)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame | None:
    """The index, or None where it has no manifest; one that was built from something else, or whose rows don't agree
    with its manifest, is an error that names the fields."""
    try:
        found = spark.read.json(f"{path}/manifest").first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    have = found.asDict() if found else {}
    wrong = sorted(k for k, v in wanted.items() if have.get(k) != v)
    if wrong:
        raise ValueError(f"the index doesn't fit: {', '.join(wrong)}")
    rows = spark.read.parquet(f"{path}/rows")
    if str(rows.count()) != have.get("row_count"):
        raise ValueError("the index doesn't fit: row_count")
    return rows


def updated_index(old: DataFrame, new: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """The rows that have to be encoded anew (added or changed), and what an index becomes: its unchanged rows and
    those. Where nothing changed the first is empty."""
    same = new.join(old.select(key, digest), [key, digest], "left_semi").select(key)
    fresh = new.join(same, key, "left_anti")
    return fresh, old.join(same, key, "left_semi").unionByName(fresh, allowMissingColumns=True)


def replaced(rows: DataFrame, path: str) -> None:
    """Replace a JSON folder: a new one is written beside it and takes its name, so that readers see one or the other."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    fresh, old, target = (hadoop.Path(path.rstrip("/") + s) for s in (".new", ".old", ""))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(fresh, True)
    rows.write.json(fresh.toString())
    files.delete(old, True)
    if files.exists(target):
        files.rename(target, old)
    files.rename(fresh, target)
    files.delete(old, True)


def run_logged(spark: SparkSession, path: str, run_id: str, work) -> None:
    """Append a row for the start and one for the end of a collection run, with its count or what failed."""
    def say(state: str, n: int | None, note: str | None) -> None:
        spark.createDataFrame([(run_id, state, n, note)], "run_id string, state string, n long, note string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)

    say("started", None, None)
    try:
        n = work()
    except Exception as e:
        say("failed", None, str(e)[:500])
        raise
    say("finished", int(n), None)


def packet(title: Column, quotes: Column, links: Column) -> Column:
    """A Markdown packet: a heading, quotes, and a list of links."""
    body = F.array_join(F.transform(quotes, lambda q: F.concat(F.lit("> "), F.regexp_replace(q, "\n", "\n> "))), "\n\n")
    listed = F.array_join(F.transform(links, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("## "), title), F.nullif(body, F.lit("")), F.nullif(listed, F.lit("")))
