"""Lines of gzip archives that may break off, as a Python data source.

A reader streams one archive: what can be unpacked is cut into lines, and the whole ones before the break are given. Each archive
ends in a row that says how it went. Memory is a chunk and a line, whatever the size of the archive; archives are read side by side.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

CHUNK, SLICE = 1 << 20, 4096
SCHEMA = "file string, line_no bigint, line string, ended boolean, kept bigint, lost_bytes bigint, error string"


def opened(path: str):
    """A stream of bytes from a local file or anything that Arrow's file systems reach."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")  # noqa: SIM115
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")  # noqa: SIM115
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_stream(name)


def unpacked(stream) -> Iterator[bytes | tuple[str, int]]:
    """Pieces of the unpacked bytes of one archive of one or more members, and then (error or "", packed bytes not used).

    Packed bytes go in by small slices, and where a slice fails by single bytes, so that what comes before the damage is kept."""
    member, error, unused, begun = zlib.decompressobj(31), "", 0, False
    while not error and (packed := stream.read(CHUNK)):
        at = 0
        while at < len(packed) and not error:
            piece, before = packed[at : at + SLICE], member.copy()
            try:
                out = member.decompress(piece)
            except zlib.error as e:
                error, member, out = str(e), before, b""
                for i in range(len(piece)):
                    try:
                        out += member.decompress(piece[i : i + 1])
                    except zlib.error:
                        unused = len(packed) - at - i
                        break
            begun, at = True, at + len(piece)
            if out:
                yield out
            if member.eof and not error:  # another member may follow
                at -= len(member.unused_data)
                while at < len(packed) and packed[at] == 0:
                    at += 1
                member, begun = zlib.decompressobj(31), False
    while error and (more := stream.read(CHUNK)):
        unused += len(more)
    if begun and not error and not member.eof:
        error = "the archive breaks off"
    yield error, unused


def lines(stream, name: str) -> Iterator[tuple]:
    """Rows of SCHEMA: each whole line, and a last row. A last line without an end counts as whole only if the archive is."""
    rest, n = b"", 0
    for piece in unpacked(stream):
        if isinstance(piece, tuple):
            error, unused = piece
            if rest and not error:
                n += 1
                yield name, n, rest.decode("utf-8", "replace").removesuffix("\r"), False, None, None, None
                rest = b""
            yield name, None, None, True, n, len(rest) + unused, error or None
            return
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            n += 1
            yield name, n, line.decode("utf-8", "replace").removesuffix("\r"), False, None, None, None


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        if partition is None or partition.path is None:
            return
        with opened(partition.path) as stream:
            yield from lines(stream, partition.path)


class ArchiveLines(DataSource):
    """Option `paths`: a JSON list of archives."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]))


def archive_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """SCHEMA rows of the archives that the paths (which may have wildcards) name, on any file system."""
    spark.dataSource.register(ArchiveLines)
    found: list[str] = []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        found += [str(s.getPath().toString()) for s in place.getFileSystem(conf).globStatus(place) or [] if s.isFile()]
    if not found:
        raise FileNotFoundError(", ".join(paths))
    return spark.read.format("archive_lines").option("paths", json.dumps(sorted(found))).load()


def partial_json_lines(spark: SparkSession, schema: str, *paths: str) -> tuple[DataFrame, DataFrame]:
    """The JSON rows before each archive's break, and a report: file, kept (whole lines), lost_bytes (of the broken line, and packed ones that
    could not be read), error (null if the archive is whole). Lines that do not parse are dropped, as by `json_lines`."""
    rows = archive_lines(spark, *paths)
    found = rows.where("not ended").select(F.from_json("line", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).where("r._corrupt_record is null")
    return found.select("r.*").drop("_corrupt_record"), rows.where("ended").select("file", "kept", "lost_bytes", "error")
