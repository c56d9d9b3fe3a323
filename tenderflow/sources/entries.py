"""Archives read by entry: a task for an entry, not for an archive.

One pass reads an archive's directory and cuts out the entries, still packed, that the caller's test
on route wants; they are dealt out by path and name, and the tasks that get them inflate and parse
them. So a large archive is parsed by many tasks, entries of other routes are never inflated, and
what is shuffled has the packed size. Archives inside of archives are entries that are cut again.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension
from . import files
from .office import MOST_BYTES, MOST_DEPTH, MOST_ENTRIES, MOST_TOTAL, SKIPPED, entry_name

CUT = "path string, name string, depth int, method int, size long, crc long, data binary"
HEADER = 30


def directory(content: bytes) -> Iterator[tuple[str, int, int, int, bytes]]:
    """name, method, size, checksum and packed bytes of an archive's entries, within limits."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return
    entries, total = MOST_ENTRIES, MOST_TOTAL
    for info in archive.infolist():
        name = entry_name(info).replace("\\", "/")
        if info.is_dir() or name.startswith("/") or ".." in name.split("/") or name.lower().endswith(SKIPPED):
            continue
        entries, total = entries - 1, total - info.file_size
        if entries < 0 or total < 0:
            return
        if info.file_size <= MOST_BYTES and not info.flag_bits & 1:
            at = info.header_offset
            start = at + HEADER + sum(int.from_bytes(content[at + k : at + k + 2], "little") for k in (26, 28))
            yield name, info.compress_type, info.file_size, info.CRC, content[start : start + info.compress_size]


def cut(archives: DataFrame, depth: int, routes: Sequence[str] | None) -> DataFrame:
    """The packed entries of rows of path and content: those of the routes, and archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                for name, method, size, crc, data in directory(content or b""):
                    yield pa.RecordBatch.from_pylist([{"path": path, "name": name, "depth": depth, "method": method, "size": size, "crc": crc, "data": data}], pa.schema([("path", pa.string()), ("name", pa.string()), ("depth", pa.int32()), ("method", pa.int32()), ("size", pa.int64()), ("crc", pa.int64()), ("data", pa.binary())]))

    every = archives.select("path", "content").mapInArrow(run, CUT)
    route = files.route(extension(F.col("name")))
    wanted = F.lit(True) if routes is None else route.isin(*routes) | (extension(F.col("name")) == "zip")
    return every.filter(wanted).repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "name")


def inflated(packed: DataFrame) -> DataFrame:
    """path, name, depth, content and error: null content where the packed bytes are none, or those
    of something else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for r in batch.to_pylist():
                content, error = None, None
                try:
                    content = r["data"] if r["method"] == zipfile.ZIP_STORED else zlib.decompressobj(-zlib.MAX_WBITS).decompress(r["data"], r["size"] + 1) if r["method"] == zipfile.ZIP_DEFLATED else None
                    error = "packed in another way" if content is None else None if len(content) == r["size"] and zlib.crc32(content) == r["crc"] else "checksum or size differs"
                except zlib.error as e:
                    error = str(e)
                out.append(None if error else content)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch["path"], batch["name"], batch["depth"], pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["path", "name", "depth", "content", "error"])

    return packed.mapInArrow(run, "path string, name string, depth int, content binary, error string")


def read(archives: DataFrame, routes: Sequence[str] | None = None) -> DataFrame:
    """SRC-5, UX-8: path, name, depth, route, content and error of the entries of all archives, and of
    archives in them down to MOST_DEPTH; path names the outer archives, joined by `!`."""
    found, level = None, archives.select("path", "content")
    for depth in range(1, MOST_DEPTH + 1):
        entries = inflated(cut(level, depth, routes))
        is_archive = extension(F.col("name")) == "zip"
        plain = entries.filter(~is_archive)
        found = plain if found is None else found.unionByName(plain)
        level = entries.filter(is_archive & F.col("content").isNotNull()).select(F.concat_ws("!", "path", "name").alias("path"), "content")
    return found.withColumn("route", files.route(extension(F.col("name")), F.substring("content", 1, 4)))
