"""Files as rows: listings, reads at an offset, archives as folders, compression by content."""

from __future__ import annotations

import bz2
import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, length, modificationTime of files, by path; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime").orderBy("path")


def list_entries(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length, is_dir of what lies directly in the folder ``path``, by path; a folder has the length of all files below it.

    ``glob`` is for the entries' own names.  Empty files and folders without files aren't listed,
    since Spark's file scan leaves them out.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    rest = F.expr("substring(path, %d)" % (len(root) + 2))
    files = list_files(spark, path).select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"), F.contains(rest, F.lit("/")).alias("is_dir"), "length")
    if glob:
        files = files.where(F.col("name").rlike(_glob_regex(glob)))
    entries = files.groupBy("name").agg(F.sum("length").alias("length"), F.bool_or("is_dir").alias("is_dir"))
    return entries.select(F.concat(F.lit(root + "/"), "name").alias("path"), "length", "is_dir").orderBy("path")


def _glob_regex(glob: str) -> str:
    """A regular expression for ``*`` and ``?``; other characters stand for themselves."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c == "_" else "\\" + c) for c in glob) + "$"


def stat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path, content of files (each under 2 GB)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_at(content: Column, offset: int, length: int) -> Column:
    return F.substring(content, offset + 1, length)


# First bytes of compressed files.
MAGIC = {"gzip": "1F8B08", "zstd": "28B52FFD", "bzip2": "425A68"}


def compression_of(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit("none")
    for name, magic in MAGIC.items():
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def _plain(kind: str, data: bytes) -> bytes:
    if kind == "gzip":
        return gzip.decompress(data)
    if kind == "bzip2":
        return bz2.decompress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    return data


def decompressed(files: DataFrame) -> DataFrame:
    """path, compression, content of files (path, content), decompressed by their first bytes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=[_plain(k, bytes(c)) for k, c in zip(b["compression"], b["content"], strict=True)])

    known = files.select("path", compression_of(F.col("content")).alias("compression"), "content")
    return known.mapInPandas(work, known.schema)


def zip_entries(files: DataFrame) -> DataFrame:
    """path ('archive.zip/entry'), length, content of each entry of zip files (path, content)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    rows = [(f"{path}/{i.filename}", i.file_size, z.read(i)) for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["path", "length", "content"])

    return files.select("path", "content").mapInPandas(work, "path string, length long, content binary")


def per_node(files: DataFrame, *functions) -> DataFrame:
    """All rows that functions (DataFrame -> DataFrame with path, length, content) derive from files, with the files themselves."""
    out = files.select("path", F.length("content").cast("long").alias("length"), "content")
    for f in functions:
        out = out.unionByName(f(files))
    return out


def write_compressed(df: DataFrame, path: str, compression: str) -> None:
    """Text lines (value), as gzip or zstd; bzip2 is for reading only."""
    if compression not in ("gzip", "zstd"):
        raise ValueError(f"writing {compression} isn't supported")
    df.select("value").write.option("compression", compression).text(path)
