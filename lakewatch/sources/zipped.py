"""Bulk XML in zip archives: members are unzipped and parsed as streams, so a task holds an archive's compressed bytes and one record."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewatch.session import ship_package

#: Rows of a batch that a task gives.
ROWS = 5_000


def landed(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, fetched_at, content) of the archives at `path`, in any store that Spark reads; an archive's name is its source."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("source_id"), F.col("modificationTime").alias("fetched_at"), "content")


def records(content: bytes, row_tag: str, fields: list[str]) -> Iterator[list[str | None]]:
    """The records of an archive's XML members, in order: texts of child elements, or attributes (`_name`)."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for member in archive.infolist():
            if member.filename.lower().endswith(".xml"):
                with archive.open(member) as stream:
                    yield from _records(stream, row_tag, fields)


def _records(stream, row_tag: str, fields: list[str]) -> Iterator[list[str | None]]:
    path = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            path.append(element)
            continue
        path.pop()
        if element.tag.rpartition("}")[2] == row_tag:
            of = {child.tag.rpartition("}")[2]: "".join(child.itertext()).strip() for child in reversed(element)}
            yield [element.get(f[1:]) if f.startswith("_") else of.get(f) for f in fields]
            element.clear()
            if path:
                path[-1].remove(element)  # what has been read doesn't stay in its parent


def zipped_records(payloads: DataFrame, row_tag: str, fields: list[str], where: dict[str, list[str]] | None = None, since: tuple[str, str] | None = None, max_items: int | None = None) -> tuple[DataFrame, DataFrame]:
    """payloads(source_id, fetched_at, content) -> (source_id, fetched_at and the fields, quarantine).

    `where` (field: values) and `since` (field, least value, as text; empty ones pass) are applied while an archive is read, before
    a record becomes a row. All records are read unless `max_items` is given. An archive or member that can't be read to its
    end is quarantined with what was wrong; the records before that stand. A null archive has none."""
    ship_package(payloads.sparkSession)
    names = ["source_id", "fetched_at", *fields, "reason"]
    tests = [(fields.index(k), frozenset(v)) for k, v in (where or {}).items()]
    at, least = (fields.index(since[0]), since[1]) if since else (None, "")

    def run(batches):
        for b in batches:
            kinds = [pa.string(), b.schema.field("fetched_at").type, *[pa.string()] * (len(fields) + 1)]
            table = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(names), kinds)], names=names)
            for source, fetched, content in zip(*(b.column(c).to_pylist() for c in ("source_id", "fetched_at", "content"))):
                rows = []
                try:
                    for record in records(content, row_tag, fields) if content is not None else ():
                        if all(record[k] in values for k, values in tests) and (at is None or not record[at] or record[at] >= least):
                            rows.append((source, fetched, *record, None))
                        if len(rows) >= ROWS:
                            yield table(rows)
                            rows = []
                except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError) as error:
                    rows.append((source, fetched, *[None] * len(fields), f"parse_error: {error}"))
                yield table(rows)

    schema = "source_id string, fetched_at timestamp, " + ", ".join(f"`{f}` string" for f in fields) + ", reason string"
    all_ = payloads.select("source_id", "fetched_at", "content").mapInArrow(run, schema)
    good = all_.where("reason IS NULL").drop("reason")
    bad = all_.where("reason IS NOT NULL").select("source_id", F.lit("parse_error").alias("reason"), F.col("reason").alias("payload"))
    return (good if max_items is None else good.limit(max_items)), bad
