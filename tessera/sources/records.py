"""Records from feeds, files and hands: the two-step scan, the registry, row parsers, text of files, imports, and the rows of an edition."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = "stable_id string, title string, text string, date string, source string"


class FeedSource(DataSource):
    """Format `feed`: cheap stubs first, then a record for each. Options: path of a file of JSON lines, since (a date; older stubs aren't fetched), pages (how many tasks fetch)."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.since, self.pages = options["path"], options.get("since", ""), max(1, int(options.get("pages", "4")))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.pages)]

    def discover(self, page: int) -> Iterator[dict]:
        with open(self.path, encoding="utf-8") as lines:
            for k, line in enumerate(lines):
                if k % self.pages == page:
                    try:
                        stub = json.loads(line)
                    except ValueError:
                        continue  # a broken line stops nothing
                    if str(stub.get("date") or "") >= self.since:
                        yield stub

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for stub in self.discover(partition.value):
            yield tuple(None if stub.get(c) is None else str(stub[c]) for c in ("stable_id", "title", "text", "date", "source"))


@dataclass(frozen=True)
class Source:
    """A source: how it is read, what may be asked of it (server, early-stop, full-walk, targeted, bulk, closed), and where it belongs."""

    key: str
    read: Callable[[SparkSession, dict], DataFrame]
    mode: str = "bulk"
    jurisdiction: str = "Other"


@dataclass
class Registry:
    """Sources by key."""

    sources: dict[str, Source] = field(default_factory=dict)

    def register(self, source: Source) -> None:
        if source.key in self.sources:
            raise ValueError(f"{source.key} is registered already")
        self.sources[source.key] = source

    def read(self, spark: SparkSession, key: str, **options: str) -> DataFrame:
        if self.sources[key].mode == "closed":
            raise ValueError(f"{key} is closed")
        return self.sources[key].read(spark, options).withColumn("source", F.lit(key))

    def catalogue(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.key, s.mode, s.jurisdiction) for s in sorted(self.sources.values(), key=lambda s: s.key)], "key string, mode string, jurisdiction string")


def parsed_rows(raw: DataFrame, mapping: dict[str, Column | str], source: str, keep: Column | None = None) -> DataFrame:
    """Records of raw rows: each field a column or an expression; rows without an id or a text, or that aren't to be kept, drop out, and of one id the first by text stays."""
    rows = raw.select(*((F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items())).withColumn("source", F.lit(source))
    rows = rows.filter(F.col("stable_id").isNotNull() & (F.trim("text") != ""))
    if keep is not None:
        rows = rows.filter(keep)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("stable_id").orderBy("text"))).filter("__r = 1").drop("__r")


def _file_text(path: str, data: bytes) -> tuple[str, bool]:
    """(text, whether it needs character recognition) of one file."""
    name = path.lower()
    if name.endswith(".docx"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
        body = re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", re.sub(r"<w:tab/>", "\t", xml)))
        return re.sub(r"&(lt|gt|amp|quot|apos);", lambda m: {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}[m[1]], body).strip(), False
    if name.endswith(".rtf"):
        body = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", data.decode("latin-1"))
        body = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), body)
        return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", re.sub(r"\\par[d]?\b ?", "\n", body))).strip(), False
    if name.endswith((".htm", ".html")):
        body = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", data.decode("utf-8", "replace"))
        return re.sub(r"\s+", " ", re.sub(r"(?s)<[^>]*>", " ", body)).strip(), False
    if name.endswith(".pdf"):
        shown = re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*T[jJ]", data)  # plain text operators; compressed streams need a reader of their own
        text = b" ".join(shown).decode("latin-1")
        return text, not text.strip()
    return data.decode("utf-8", "replace"), False


def files_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash, text, needs_ocr) of HTML, DOCX, RTF, PDF and text files; a file that can't be read has an empty text and needs_ocr."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, h, data in zip(f["path"], f["hash"], f["content"]):
                try:
                    out.append((p, h, *_file_text(p, bytes(data))))
                except (KeyError, zipfile.BadZipFile, UnicodeDecodeError):
                    out.append((p, h, "", True))
            yield pd.DataFrame(out, columns=["path", "hash", "text", "needs_ocr"])

    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("hash"), "content")
    return rows.mapInPandas(run, "path string, hash string, text string, needs_ocr boolean")


def imported(docs: DataFrame, rel: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, rel) with notes (title, text, about) added: a note's id is the hash of its text, one that is held isn't added again, and one about a document gets an edge to it."""
    new = notes.withColumn("stable_id", F.concat(F.lit("note/"), F.left(F.sha2(F.col("text"), 256), F.lit(16)))).dropDuplicates(["stable_id"])
    fresh = new.join(docs.select("stable_id"), "stable_id", "left_anti")
    edges = new.filter(F.col("about").isNotNull()).select(F.col("stable_id").alias("src_id"), F.col("about").alias("dst_id"), F.lit("mentions").alias("type"), F.lit("manual").alias("via"))
    edges = edges.join(rel.select("src_id", "dst_id"), ["src_id", "dst_id"], "left_anti")
    return docs.unionByName(fresh.select(*docs.columns)), rel.unionByName(edges.select(*rel.columns))


def edition(rel: DataFrame, citing: DataFrame, rank: DataFrame, per_provision: int | None = None) -> DataFrame:
    """(dst_id, provision, n, citers): the page of each cited document, provision by provision: how many documents cite it, and those of high rank first; all of them, unless so many are asked for."""
    rows = rel.filter((F.col("status") == "resolved") & (F.col("via") != "inferred") & (F.col("type") != "cited_by")).select("dst_id", F.coalesce("dst_anchor", F.lit("")).alias("provision"), "src_id").distinct()
    rows = rows.join(citing.select(F.col("stable_id").alias("src_id")), "src_id", "left_semi").join(rank.select(F.col("node").alias("src_id"), "rank"), "src_id", "left")
    w = Window.partitionBy("dst_id", "provision").orderBy(F.desc_nulls_last("rank"), "src_id")
    rows = rows.withColumn("__r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("dst_id", "provision")))
    if per_provision is not None:
        rows = rows.filter(F.col("__r") <= per_provision)
    return rows.groupBy("dst_id", "provision", "n").agg(F.array_sort(F.collect_list(F.struct("__r", "src_id"))).alias("__c")).select("dst_id", "provision", "n", F.col("__c.src_id").alias("citers"))


def pushed(alerts: DataFrame, send: Callable[[list[dict]], None], checkpoint: str, most: int = 500):
    """A stream of alerts handed to a notifier, micro-batch by micro-batch, at most `most` in a message."""

    def push(rows: DataFrame, _: int) -> None:
        block: list[dict] = []
        for r in rows.toLocalIterator():
            block.append(r.asDict())
            if len(block) == most:
                send(block)
                block = []
        if block:
            send(block)

    return alerts.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(push).start()
