"""A data source of paginated API dumps, for batches and for streams that go on where they stopped.

A dump is a folder with one folder a page, `page=N`, whose files each hold a JSON list of items (or a list of lists). Partitions
are ranges of pages, and a task reads its range page by page as Arrow batches, so that no page is read twice and only one is
held. A stream's offset is the number of the last page that it has read; pages that arrive later are its next batches, and a
page counts from when its folder has no more unfinished files beside it.

Register with `register(spark)`, then `spark.read.format("pages").schema(...).load(path)` or `spark.readStream`. Option:
`pagesPerPartition` (16). Pages of a stream are numbered upwards as they come. Defined results: fields that an item lacks are null, and others
that it has are left out; an empty page has no rows; a folder without pages has none; a page that isn't a list of objects is
an error that names it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGE = re.compile(r"page=(\d+)$")


class Pages(InputPartition):
    """The pages first to last of a range."""

    def __init__(self, numbers: list[int]):
        super().__init__(numbers)
        self.numbers = numbers


class Dump:
    """Which pages there are, and their items."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.per_partition = int(options.get("pagesperpartition", "16"))

    def store(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)

    def numbers(self) -> list[int]:
        files, root = self.store()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(m[1]) for f in found if f.type == fs.FileType.Directory and (m := PAGE.search(f.path)) and not self.unfinished(files, f.path))

    def unfinished(self, files: fs.FileSystem, folder: str) -> bool:
        return any(f.base_name.startswith("_temporary") or f.extension == "tmp" for f in files.get_file_info(fs.FileSelector(folder)))

    def split(self, numbers: list[int]) -> list[Pages]:
        return [Pages(numbers[i : i + self.per_partition]) for i in range(0, len(numbers), self.per_partition)]

    def batches(self, part: Pages) -> Iterator[pa.RecordBatch]:
        files, root = self.store()
        schema = to_arrow_schema(self.schema)
        for n in part.numbers:
            for f in sorted(files.get_file_info(fs.FileSelector(f"{root}/page={n}")), key=lambda f: f.path):
                if f.type == fs.FileType.File and f.base_name[0] not in "._":
                    with files.open_input_stream(f.path) as stream:
                        yield from self.items(n, stream.read().decode(), schema)

    def items(self, n: int, text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for line in filter(None, map(str.strip, text.split("\n"))):
            try:
                rows = json.loads(line)
                flat = [x for r in rows for x in r] if rows and all(isinstance(r, list) for r in rows) else rows
                if not isinstance(rows, list) or not all(isinstance(r, dict) for r in flat):
                    raise ValueError("not a list of objects")
                yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in schema.names} for r in flat], schema=schema)
            except (ValueError, TypeError) as e:
                raise ValueError(f"page {n}: {e}") from e


class PageReader(DataSourceReader):
    def __init__(self, dump: Dump):
        self.dump = dump

    def partitions(self) -> list[Pages]:
        return self.dump.split(self.dump.numbers()) or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.dump.batches(partition)


class PageStream(DataSourceStreamReader):
    """Offsets: the last page that was read."""

    def __init__(self, dump: Dump):
        self.dump = dump

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": max(self.dump.numbers(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.dump.split([n for n in self.dump.numbers() if start["page"] < n <= end["page"]])

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.dump.batches(partition)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        raise ValueError("pages are read with a schema")

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(Dump(schema, {k.lower(): v for k, v in self.options.items()}))

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(Dump(schema, {k.lower(): v for k, v in self.options.items()}))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def dumped(items, path: str, page, first: int = 1) -> None:
    """Write `items` as a dump: `page` numbers their pages from `first`."""
    from pyspark.sql import functions as F

    listed = F.to_json(F.sort_array(F.collect_list(F.struct(*items.columns)))).alias("value")
    items.groupBy((page + first).cast("long").alias("page")).agg(listed).write.mode("append").partitionBy("page").text(path)
