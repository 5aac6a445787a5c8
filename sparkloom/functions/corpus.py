"""Rules over paths, Markdown, JSON and chunks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.dialogue import quoted_scalar

# Where paths name their category and module, and what anchors look like.
CATEGORY = r"(?:knowledge/cs/)?contents/([a-z][a-z0-9_-]+)/"
MODULE = r"(spring-[a-z-]+?-[0-9]+)"
ANCHORS = [r"(?m)^#{2,6}\s+([^{\n]+)", r'<a id="([^"]+)"', r"\{#([A-Za-z0-9_-]+)\}", r"\]\([^)#]*#([^)]+)\)", r"\*\*([^*]+)\*\*:"]


def category_of(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, CATEGORY, 1), F.lit("")), F.lit("unknown"))


def module_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, MODULE, 1), F.lit(""))


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """A value by key from a small table; null where there is none."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def allowed(point: Column, table: dict[str, list[str]], general: list[str]) -> Column:
    """The categories of a learning point, else the general ones."""
    out = None
    for k, v in table.items():
        out = F.when(point == k, F.array(*map(F.lit, v))) if out is None else out.when(point == k, F.array(*map(F.lit, v)))
    return out.otherwise(F.array(*map(F.lit, general)))


def front_matter_header(text: Column, category: Column, fallback: Column) -> Column:
    """A front-matter block: the first line as title (else a fallback), the category, and a difficulty by length."""
    title = F.trim(F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), r"^#+\s*", ""))
    title = F.coalesce(F.nullif(title, F.lit("")), fallback)
    n = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    level = F.when(n < 100, "beginner").when(n < 400, "intermediate").otherwise("advanced")
    return F.concat(F.lit("---\ntitle: "), quoted_scalar(title), F.lit("\ncategory: "), category, F.lit("\ndifficulty: "), level, F.lit("\n---\n"))


def anchors(text: Column) -> Column:
    """Distinct anchors in all styles, lower-cased."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.lower(F.trim(x))) for p in ANCHORS]
    return F.array_distinct(F.concat(*found))


def violations(rows: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Rows that break a rule, with `errors`: each broken path and what is wrong with it. rules: path -> (message,
    condition)."""
    broken = F.concat_ws("; ", *(F.when(c, f"{path}: {said}") for path, (said, c) in rules.items()))
    return rows.withColumn("errors", broken).filter(F.col("errors") != "")


def asserted(json: str, path: str, kind: str, want: str | None = None) -> Column:
    """One assertion on a JSON path: equals, contains, truthy or not_empty."""
    found = F.get_json_object(json, path)
    if kind == "equals":
        return found == want
    if kind == "contains":
        return F.coalesce(found, F.lit("")).contains(want)
    if kind in ("truthy", "not_empty"):
        return found.isNotNull() & (found != "")
    raise ValueError(f"unknown assertion {kind!r}")


def first_rung(rows: DataFrame, ladder: dict[str, Column], budget: int) -> DataFrame:
    """`rows` with the first rung of a ladder of text lists whose joined bytes fit a budget, and those bytes; none has 0."""
    size = {k: F.octet_length(F.array_join(v, " ")) for k, v in ladder.items()}
    name, n = F.lit("none"), F.lit(0)
    for k in reversed(ladder):
        name, n = F.when(size[k] <= budget, k).otherwise(name), F.when(size[k] <= budget, size[k]).otherwise(n)
    return rows.withColumns({"rung": name, "n_bytes": n})


def chunked(words: Column, size: int) -> Column:
    """Lists of `size` words."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(words, i * size + 1, size)))
