"""Schedule feeds: unpacked folders by the CSV reader, zip files by a data source of their own."""

from __future__ import annotations

import csv
import io
import zipfile
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tripflow.operators.skew import join_on_hot_keys
from tripflow.sources.shared import cut

# Columns read from each feed file.
FEED_SCHEMAS = {
    "stop_times": (
        "trip_id string, arrival_time string, departure_time string, "
        "stop_id string, stop_sequence int"
    ),
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "trips": "route_id string, service_id string, trip_id string",
}
BATCH_ROWS = 20_000


def feed_columns(table: str) -> dict[str, str]:
    """Column names and types of a feed file."""
    return dict(part.split() for part in FEED_SCHEMAS[table].split(", "))


def _header(line: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([line.lstrip("﻿").strip()]), [])]


def _files(spark: SparkSession, folder: str, pattern: str) -> list:
    """Hadoop paths of a folder's files; the folder may lie in any store Spark reads."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath() for status in system.globStatus(found) or []]


def _first_line(spark: SparkSession, path) -> str:
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def read_feed_folders(
    spark: SparkSession, folders: Mapping[str, str], table: str = "stop_times", pattern: str | None = None
) -> DataFrame:
    """A feed file out of one unpacked folder per agency, stacked.

    Feeds order their columns differently: the first line of each feed is looked
    at, and feeds with the same columns are one scan. So there are as many scans
    as kinds of headers, however many agencies, and no job before the query.
    ``pattern`` names the file where a feed is split into several; those have
    equal headers. Types come from the declared schema and values that do not fit
    are NULL. A folder without the file is left out, like a zip without it.
    """
    kinds = feed_columns(table)
    alike = defaultdict(list)
    for agency, folder in folders.items():
        files = _files(spark, folder, pattern or f"{table}.txt")
        if files:
            alike[tuple(_header(_first_line(spark, files[0])))].append((agency, files))

    def scan(names: tuple[str, ...], feeds: list) -> DataFrame:
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        paths = [path.toString() for _, files in feeds for path in files]
        text = spark.read.option("header", True).schema(schema).csv(paths)
        agency_of = {path.getParent().toUri().toString(): agency for agency, files in feeds for path in files}
        folder = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/", 1), "^file:/+", "file:/")
        agencies = F.create_map(*[F.lit(x) for pair in agency_of.items() for x in pair])
        place = {name: f"c{i}" for i, name in reversed(list(enumerate(names)))}
        return text.select(
            F.element_at(agencies, folder).alias("agency"),
            *[(F.col(place[c]) if c in place else F.lit(None)).try_cast(k).alias(c) for c, k in kinds.items()],
        )

    empty = spark.createDataFrame([], f"agency string, {FEED_SCHEMAS[table]}")
    return reduce(DataFrame.unionByName, [scan(*feeds) for feeds in alike.items()], empty)


class FeedZip(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FeedZips(DataSource):
    """Zip files of a folder, one partition each, streamed member by member.

    Nothing holds a whole zip: the member is unpacked as it is read, and its rows
    leave in batches. The folder is a path or URI of a file system that pyarrow
    knows (local or mounted, HDFS, S3, GCS).
    """

    @classmethod
    def name(cls) -> str:
        return "feed_zips"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in ["agency", *feed_columns(self.options["table"])])

    def reader(self, schema) -> FeedZipReader:
        return FeedZipReader(self.options["path"], self.options["table"])


def _store(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FeedZipReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self) -> list[FeedZip]:
        from pyarrow import fs

        store, path = _store(self.path)
        found = store.get_file_info(fs.FileSelector(path))
        # A folder without zips still has one partition, which reads nothing.
        return [FeedZip(info.path) for info in found if info.path.endswith(".zip")] or [FeedZip("")]

    def read(self, partition: FeedZip) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        columns = list(feed_columns(self.table))
        agency = partition.path.rsplit("/", 1)[-1].removesuffix(".zip")
        with _store(self.path)[0].open_input_file(partition.path) as file, zipfile.ZipFile(file) as feed:
            if f"{self.table}.txt" not in feed.namelist():
                return
            with feed.open(f"{self.table}.txt") as member:
                lines = csv.reader(io.TextIOWrapper(member, encoding="utf-8-sig", newline=""))
                names = [name.strip() for name in next(lines, [])]
                at = [names.index(c) if c in names else -1 for c in columns]
                values: list[list[str | None]] = [[] for _ in columns]
                for line in lines:
                    if not line:
                        continue
                    for i, out in zip(at, values, strict=True):
                        out.append(line[i] or None if 0 <= i < len(line) else None)
                    if len(values[0]) == BATCH_ROWS:
                        yield _batch(agency, columns, values)
                        values = [[] for _ in columns]
                if values[0]:
                    yield _batch(agency, columns, values)


def _batch(agency: str, columns: list[str], values: list[list[str | None]]) -> pa.RecordBatch:
    arrays = [pa.array([agency] * len(values[0]), pa.string()), *[pa.array(v, pa.string()) for v in values]]
    return pa.RecordBatch.from_arrays(arrays, names=["agency", *columns])


def read_feed_zips(spark: SparkSession, path: str, table: str = "stop_times") -> DataFrame:
    """A feed file out of many zip files, one task per file; the agency is the file name.

    A zip cannot be split, so each file is one unit of work, read as a stream.
    """
    spark.dataSource.register(FeedZips)
    text = spark.read.format("feed_zips").option("path", path).option("table", table).load()
    return text.select("agency", *[F.col(c).try_cast(k).alias(c) for c, k in feed_columns(table).items()])


def write_feed_folders(feed: DataFrame, path: str, columns: list[str]) -> None:
    """A feed table as CSV files with headers, in a folder ``agency=...`` per agency.

    As many tasks write an agency as hold its rows.
    """
    feed.select("agency", *columns).write.option("header", True).partitionBy("agency").csv(path)


def write_feed_zips(feed: DataFrame, path: str, table: str = "stop_times", rows_per_zip: int = 500_000) -> DataFrame:
    """(agency, part, n_rows) of the zips ``agency.part.zip`` written to the folder ``path``.

    A zip is written by one task, so an agency's rows are dealt by hash over as
    many zips as hold about ``rows_per_zip`` rows. The numbers of zips are stored, so
    that Spark knows how few they are and moves no agency whole into one task to
    join them. A task that runs again writes the same rows to the same place.
    """
    columns = list(feed_columns(table))
    counts = cut(feed.groupBy("agency").agg(F.ceil(F.count(F.lit(1)) / rows_per_zip).cast("int").alias("parts")))
    text = [F.col(c).cast("string").alias(c) for c in columns]
    dealt = join_on_hot_keys(feed, counts, ["agency"]).select(
        "agency", F.pmod(F.xxhash64(*columns), F.col("parts")).cast("int").alias("part"), *text
    )

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        agency, part = (k.as_py() for k in key)
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{agency}.{part}.zip") as out:
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as feed_zip, feed_zip.open(f"{table}.txt", "w") as member:
                lines = io.TextIOWrapper(member, encoding="utf-8", newline="")
                writer = csv.writer(lines)
                writer.writerow(columns)
                ordered = rows.select(columns).sort_by([(c, "ascending") for c in columns])
                for batch in ordered.to_batches(max_chunksize=BATCH_ROWS):
                    writer.writerows(zip(*[column.to_pylist() for column in batch.columns], strict=True))
                lines.flush()
                lines.detach()
            out.write(packed.getvalue())
        return pa.table({"agency": [agency], "part": pa.array([part], pa.int32()), "n_rows": pa.array([rows.num_rows], pa.int64())})

    return dealt.groupBy("agency", "part").applyInArrow(pack, "agency string, part int, n_rows long")
