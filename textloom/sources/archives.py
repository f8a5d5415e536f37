"""Members of zip and tar archives as rows, filtered by globs, and resumable collection."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Format by suffix.
SUFFIXES = {".html": "html", ".htm": "html", ".xml": "xml", ".sgml": "sgml", ".md": "markdown", ".markdown": "markdown", ".rst": "text", ".txt": "text", ".sql": "text"}


def _members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, info.file_size, lambda info=info: z.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for info in t:
                if info.isfile():
                    yield info.name, info.size, lambda info=info: t.extractfile(info).read()


def read_archives(spark: SparkSession, path: str, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = (), strip: int = 0, most_bytes: int = 1 << 30) -> DataFrame:
    """(archive, member, content, error) of every archive below path; member paths lose strip leading parts. A member of
    over most_bytes, an unreadable one or a broken archive is a row with an error and no content (nor member, if it is the
    archive). One archive is one task's work."""

    def row(archive: str, member: str | None, content: bytes | None, error: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([member], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["archive", "member", "content", "error"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    for member, size, take in _members(name, content.as_py()):
                        inner = "/".join(member.split("/")[strip:])
                        if not inner or not any(fnmatch(inner, g) for g in include) or any(fnmatch(inner, g) for g in exclude):
                            continue
                        if size > most_bytes:
                            yield row(name, inner, None, f"{size} bytes, over {most_bytes}")
                            continue
                        try:
                            yield row(name, inner, take(), None)
                        except (OSError, EOFError, RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error) as e:
                            yield row(name, inner, None, f"{type(e).__name__}: {e}")
                except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error) as e:
                    yield row(name, None, None, f"{type(e).__name__}: {e}")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "archive string, member string, content binary, error string")


def decoded(content: Column) -> Column:
    """(text, replaced): UTF-8 without a byte order mark; what is not valid becomes U+FFFD and is counted."""
    text = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    return F.struct(text.alias("text"), (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))).alias("replaced"))


def format_of(path: Column, content_type: Column | None = None) -> Column:
    found = F.lit(None).cast("string")
    for suffix, name in SUFFIXES.items():
        found = F.coalesce(found, F.when(F.lower(path).endswith(suffix), name))
    if content_type is not None:
        found = F.coalesce(found, F.when(content_type.contains("html"), "html").when(content_type.contains("xml"), "xml"))
    return F.coalesce(found, F.lit("text"))


def new_only(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of found whose (url, content_hash) is not stored yet: collection goes on where it stopped."""
    return found.join(stored.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


def sitemap_urls(spark: SparkSession, path: str, include: str = ".*", exclude: str | None = None) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url")).filter(F.col("url").rlike(include)).distinct()
    return rows.filter(~F.col("url").rlike(exclude)) if exclude else rows
