"""Sources: files to rows. Readers are lazy, schemas are given, and filters reach the scan."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_by_folder(spark: SparkSession, path: str, *, folders: list[str] | None = None, min_year: int | None = None, after: str | None = None, text: tuple[str, ...] = ("text",)) -> DataFrame:
    """Parquet of a folder for each court: `court` is the folder's name, text the first column that isn't empty, rows without text are dropped."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).withColumn("court", F.element_at(F.split("_metadata.file_path", "/"), -2))
    if folders:
        rows = rows.filter(F.col("court").isin(*folders))
    if min_year:
        rows = rows.filter(F.col("year") >= min_year)
    if after:
        rows = rows.filter(F.col("date") > after)
    best = F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in text))
    return rows.withColumn("text", best).filter(F.col("text").isNotNull())


def first_rendition(spark: SparkSession, paths: list[str], key: str) -> DataFrame:
    """The first of several renditions that holds any row, one row for each key."""
    for p in paths:
        rows = spark.read.parquet(p)
        if not rows.isEmpty():
            return rows.dropDuplicates([key])
    return spark.read.parquet(paths[-1]).limit(0)


def json_lines(spark: SparkSession, path: str, schema, where: Column | None = None) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if where is None else rows.filter(where)


def csv_star(spark: SparkSession, facts: str, dimensions: dict[str, tuple[str, str]], **options: str) -> DataFrame:
    """A fact CSV joined to dimension CSVs: {path: (fact key, dimension key)}; gz and bz2 by name, quotes escaped by backslash."""
    read = lambda p: spark.read.options(header="true", multiLine="true", escape="\\", **options).csv(p)
    rows = read(facts)
    for path, (left, right) in dimensions.items():
        d = read(path)
        rows = rows.join(d.withColumnRenamed(right, left), left, "left")
    return rows


def archive_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, content) of ZIP archives, nested ones too, and TAR archives; one member at a time is in memory."""

    def unzip(data: bytes) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                if name.lower().endswith(".zip"):
                    yield from ((f"{name}/{n}", d) for n, d in unzip(z.read(name)))
                elif name.endswith(suffix) and not name.endswith("/"):
                    yield name, z.read(name)

    def untar(data: bytes) -> Iterator[tuple[str, bytes]]:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile() and m.name.endswith(suffix):
                    yield m.name, t.extractfile(m).read()

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"]):
                for name, content in untar(data) if ".tar" in p.lower() or p.lower().endswith(".tgz") else unzip(data):
                    yield pd.DataFrame({"archive": [p], "member": [name], "content": [content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, content binary")


def pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text and links of raw HTML pages."""
    from ..functions.text import strip_html

    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*?href="([^"#]+)"'), F.lit(1)))
    return pages.select("page_id", "url", title.alias("title"), strip_html(F.col("html")).alias("text"), links.alias("links"))


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def raw_objects(spark: SparkSession, path: str) -> DataFrame:
    """(hash, path, length, content) of files."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("hash"), "path", "length", "content")
