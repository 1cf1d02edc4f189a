"""A stream of changed records from a source that is read by a compound cursor.

Records are ordered by (updated_on, id); a stream's offset is the cursor of the last
record taken, so a stream that stopped between records of one time goes on with the
next of them.  A batch is what lies after one cursor up to another.  It is divided by
count: the source is asked how many records it has there and for the cursors that stand
at equal distances, and each task pages through one stretch.  A record that changes
while it is read moves behind the batch and comes with a later one.

The source is a class, named by the option api as "module:Class" and made with the
options.  It answers
    head() -> cursor of its last record, or None
    count(after, upto) -> number of records with after < cursor <= upto
    seek(after, n) -> cursor of the n-th record after a cursor
    page(after, upto, limit) -> the first rows with after < cursor <= upto, in order
where a cursor is a pair of texts; ("", "") is before everything.  Its own order of
cursors counts: ids may be numbers.  Passing errors are retried as in paged.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gridtally.sources.paged import named, patient

START = ("", "")
#: Rows of a task, and of a request, where the options do not say.
TASK_ROWS, PAGE_ROWS = 50_000, 1000
#: Rows of a file of a table that is laid out in the order of its cursor.
FILE_ROWS = 50_000


class Stretch(InputPartition):
    def __init__(self, after: tuple[str, str], upto: tuple[str, str]):
        self.after, self.upto = after, upto


class ChangeSource(DataSource):
    """Options: api, schema, and since, the time after which a new stream begins."""

    @classmethod
    def name(cls) -> str:
        return "gridtally_changes"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeReader(dict(self.options), schema)


def as_offset(cursor: tuple[str, str]) -> dict:
    return {"updated_on": cursor[0], "id": cursor[1]}


def as_cursor(offset: dict) -> tuple[str, str]:
    return offset["updated_on"], offset["id"]


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.options, self.fields = options, schema.names
        self.api = named(options["api"])(options)

    def initialOffset(self) -> dict:
        return as_offset((self.options.get("since", ""), ""))

    def latestOffset(self) -> dict:
        head = patient(self.api.head)
        return as_offset(head) if head else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        after, upto = as_cursor(start), as_cursor(end)
        total = patient(self.api.count, after, upto)
        each = int(self.options.get("taskRows", TASK_ROWS))
        cuts = [patient(self.api.seek, after, n) for n in range(each, total, each)]
        return [Stretch(a, b) for a, b in zip([after, *cuts], [*cuts, upto], strict=True)] if total else []

    def read(self, partition: Stretch) -> Iterator[tuple]:
        api, size = named(self.options["api"])(self.options), int(self.options.get("pageRows", PAGE_ROWS))
        after = partition.after
        while True:
            rows = patient(api.page, after, partition.upto, size)
            for row in rows:
                yield tuple(row.get(f) for f in self.fields)
            if len(rows) < size:
                return
            after = rows[-1]["updated_on"], rows[-1]["id"]

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def change_stream(spark: SparkSession, api: str, schema: str, **options: str) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("gridtally_changes").options(api=api, schema=schema, **options).load()


class TableApi:
    """A stand-in for such a source: the records of a small Parquet table, in the order of its cursor.

    It holds the whole table; OrderedApi holds one file of it.
    Option table is the path; the table has updated_on, a text, and id, a number's text.
    limit may name a file with a number: only so many records are there yet.
    """

    def __init__(self, options: dict):
        import pyarrow.parquet as pq

        rows = pq.read_table(options["table"]).to_pylist()
        rows.sort(key=lambda r: (r["updated_on"], int(r["id"])))
        if "limit" in options:
            with open(options["limit"]) as held:
                rows = rows[: int(held.read())]
        self.rows = rows
        self.keys = [(r["updated_on"], int(r["id"])) for r in rows]

    def _place(self, cursor: tuple[str, str]) -> int:
        """The number of records up to a cursor."""
        return bisect_right(self.keys, (cursor[0], int(cursor[1] or -1)))

    def head(self) -> tuple[str, str] | None:
        return (self.rows[-1]["updated_on"], self.rows[-1]["id"]) if self.rows else None

    def count(self, after, upto) -> int:
        return self._place(upto) - self._place(after)

    def seek(self, after, n: int) -> tuple[str, str]:
        row = self.rows[self._place(after) + n - 1]
        return row["updated_on"], row["id"]

    def page(self, after, upto, limit: int) -> list[dict]:
        low = self._place(after)
        return self.rows[low : min(self._place(upto), low + limit)]


def lay_out(records: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write records in the order of their cursor, in files of so many rows, for OrderedApi.

    Beside them stands where each file begins and how many rows it has.
    """
    number = F.col("id").cast("bigint")
    records.orderBy("updated_on", number).write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    held = records.sparkSession.read.schema(records.schema).parquet(f"{path}/rows")
    begin = F.min(F.struct("updated_on", number.alias("number"))).alias("begin")
    files = held.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    files.agg(F.count("*").alias("rows"), begin).select("file", "rows", "begin.*").write.parquet(f"{path}/files")


class OrderedApi:
    """A source over a table that lay_out wrote; it holds a row per file and one file.

    Options as TableApi's; table and limit may be URIs.
    """

    def __init__(self, options: dict):
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(options["table"])
        files = pq.read_table(f"{self.root}/files", filesystem=self.fs).to_pylist()
        files.sort(key=lambda x: (x["updated_on"], x["number"]))
        self.files = [x["file"] for x in files]
        self.begins = [(x["updated_on"], x["number"]) for x in files]
        self.starts = [0, *accumulate(x["rows"] for x in files)]
        self.total = self.starts[-1]
        if "limit" in options:
            fs, path = FileSystem.from_uri(options["limit"])
            with fs.open_input_file(path) as held:
                self.total = min(self.total, int(held.read()))
        self.at, self.rows, self.keys = -1, None, []

    def _open(self, n: int) -> None:
        """Hold the n-th file."""
        if n != self.at:
            import pyarrow.parquet as pq

            self.rows = pq.read_table(f"{self.root}/rows/{self.files[n]}", filesystem=self.fs)
            ids = map(int, self.rows["id"].to_pylist())
            self.at, self.keys = n, list(zip(self.rows["updated_on"].to_pylist(), ids, strict=True))

    def _place(self, cursor: tuple[str, str]) -> int:
        """The number of records up to a cursor."""
        key = cursor[0], int(cursor[1] or -1)
        n = bisect_right(self.begins, key) - 1
        if n < 0:
            return 0
        self._open(n)
        return min(self.total, self.starts[n] + bisect_right(self.keys, key))

    def _slice(self, low: int, high: int) -> list[dict]:
        """The records from a place on up to another."""
        found = []
        while low < high:
            n = bisect_right(self.starts, low) - 1
            self._open(n)
            end = min(high, self.starts[n + 1])
            found += self.rows.slice(low - self.starts[n], end - low).to_pylist()
            low = end
        return found

    def _cursor(self, place: int) -> tuple[str, str]:
        row = self._slice(place, place + 1)[0]
        return row["updated_on"], row["id"]

    def head(self) -> tuple[str, str] | None:
        return self._cursor(self.total - 1) if self.total else None

    def count(self, after, upto) -> int:
        return self._place(upto) - self._place(after)

    def seek(self, after, n: int) -> tuple[str, str]:
        return self._cursor(self._place(after) + n - 1)

    def page(self, after, upto, limit: int) -> list[dict]:
        low = self._place(after)
        last = upto[0], int(upto[1] or -1)
        found = self._slice(low, min(self.total, low + limit))
        return found[: bisect_right(found, last, key=lambda r: (r["updated_on"], int(r["id"])))]
