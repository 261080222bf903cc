"""Pages from folders, archives and links; decoded images."""

from __future__ import annotations

import io
import os
import struct
import urllib.request
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.naming import basename, is_image
from ..storage import materialize


#: Rows, and bytes of content, that a task hands on at once.
LISTED, HELD = 10_000, 16 << 20


def _opened(folder: str) -> tuple[fs.FileSystem, str, str]:
    """A folder's file system, its path there, and what makes that path a URI."""
    system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    if isinstance(system, fs.LocalFileSystem):
        return system, os.path.abspath(base), "file:"
    head, _, rest = folder.partition("://")
    host = rest.partition("/")[0]
    return system, base.rstrip("/"), f"{head}://" if base.startswith(host) else f"{head}://{host}"


def _entries(system: fs.FileSystem, base: str) -> Iterator[tuple[str, int]]:
    """Path and length of the files directly in a folder; a local one is read as it is listed."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(base) as found:
            yield from ((f.path, f.stat().st_size) for f in found if f.is_file())
    else:
        yield from ((f.path, f.size) for f in system.get_file_info(fs.FileSelector(base)) if f.is_file)


def list_files(spark: SparkSession, folders: str | DataFrame, content: bool = False) -> DataFrame:
    """Files directly in a folder, or in each of many (folder): rows (path, length), and content if asked for.

    The driver lists nothing: some folders are a task, which hands their files on in parts. So the largest folder sets the longest task.
    """
    if isinstance(folders, str):
        folders = spark.createDataFrame([(folders,)], "folder string")
    names = ["path", "length", "content"][: 2 + content]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder in frame["folder"]:
                system, base, head = _opened(folder)
                rows, held = [], 0
                for path, length in _entries(system, base):
                    rows.append((head + path, length))
                    if content:
                        with system.open_input_stream(path) as f:
                            rows[-1] += (f.read(),)
                        held += length
                    if len(rows) == LISTED or held > HELD:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    spread = folders.select("folder").repartition(folders.count() // 8 + 1)
    return spread.mapInPandas(run, "path string, length long" + ", content binary" * content)


def list_pages(spark: SparkSession, folders: str | DataFrame) -> DataFrame:
    """Image files directly in a folder, or in each of many (folder): title, file, path, length."""
    files = list_files(spark, folders).filter(is_image(F.col("path")))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("title"), basename(F.col("path")).alias("file"), "path", "length")


def read_images(spark: SparkSession, folders: str | DataFrame) -> DataFrame:
    """Decoded images, as Spark's image source has them, of a folder or of many (folder); files that can't be decoded are left out.

    That source has the driver list all files and a task for every few; here files are listed and read as any others are, and only its decoder is called.
    """
    files = list_files(spark, folders, content=True)
    origin = F.regexp_replace("path", "^file:/", "file:///")
    for c in '% "#<>?[]\\^`{|}':  # an origin is a URI
        origin = F.replace(origin, F.lit(c), F.lit(f"%{ord(c):02X}"))
    # the number keeps the filter from being pushed down, which would decode each image twice
    decoded = files.select(_decoded(spark, origin, F.col("content")).alias("image"), F.monotonically_increasing_id().alias("n"))
    return decoded.filter(F.col("image.height").isNotNull() & (F.col("n") >= 0)).select("image")


def _decoded(spark: SparkSession, origin: Column, content: Column) -> Column:
    """The image that the decoder of Spark's image source makes of a file's bytes, with fields that are null if it can't. The decoder is the
    method of a Scala object, to be called as an expression; so nothing leaves the JVM."""
    jvm = spark._jvm
    objects, types, columns = jvm.org.apache.spark.sql.catalyst.expressions.objects, jvm.org.apache.spark.sql.types, jvm.org.apache.spark.sql.classic.ExpressionUtils
    schema = "org.apache.spark.ml.image.ImageSchema"
    named = lambda name: jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(name)
    seq = lambda *x: jvm.PythonUtils.toSeq(list(x))

    def call(on, method: str, kind: str, *args):
        kind = types.DataType.fromDDL(kind) if "." not in kind else types.ObjectType(named(kind))
        if isinstance(on, str):
            return objects.StaticInvoke(named(on), kind, method, seq(*args), seq(), True, True, True, jvm.scala.Option.empty())
        return objects.Invoke(on, method, kind, seq(*args), seq(), False, True, True)

    text = lambda c: call(columns.expression(c._jc), "toString", "java.lang.String")
    field = call(call("java.lang.Class", "forName", "java.lang.Class", text(F.lit(f"{schema}$"))), "getField", "java.lang.reflect.Field", text(F.lit("MODULE$")))
    decoder = call(field, "get", f"{schema}$", jvm.org.apache.spark.sql.catalyst.expressions.Literal(None, types.ObjectType(named("java.lang.Object"))))
    option = call(decoder, "decode", "scala.Option", text(origin), columns.expression(content._jc))
    row = objects.UnwrapOption(types.ObjectType(named("org.apache.spark.sql.Row")), option)
    image = call(row, "getStruct", "org.apache.spark.sql.Row", columns.expression(F.lit(0)._jc))
    part = lambda get, kind: Column(columns.column(call(schema, get, kind, image)))
    numbers = {"height": "getHeight", "width": "getWidth", "nChannels": "getNChannels", "mode": "getMode"}
    return F.struct(origin.alias("origin"), *[part(get, "int").alias(name) for name, get in numbers.items()], part("getData", "binary").alias("data"))


def archive_members(archives: DataFrame) -> DataFrame:
    """Rows (path, content) of zip archives as rows (archive, member, length, content); folders aren't members, and a file that isn't
    a zip archive gives no row. Members are handed on in parts of some 16 MB."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "length", "content"]
        for frame in frames:
            rows, held = [], 0
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            if not info.is_dir():
                                data = z.read(info)
                                rows.append((path, info.filename, len(data), data))
                                held += len(data)
                                if held > 16 << 20:
                                    yield pd.DataFrame(rows, columns=columns)
                                    rows, held = [], 0
                except zipfile.BadZipFile:
                    continue
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, length long, content binary")


def missing(wanted: DataFrame, present: DataFrame, on: str = "name") -> DataFrame:
    """Resources that have to be fetched."""
    return wanted.join(present.select(on), on, "left_anti")


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", options.get("path", "")).split() if u]
        self.agent = options.get("agent", "foliospark")
        self.chunk = int(options.get("chunk", "8192"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """One file a task; what can't be fetched is a row with the error."""
        url = partition.value
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=60) as r:
                parts = iter(lambda: r.read(self.chunk), b"")
                yield url, r.headers.get("content-disposition"), b"".join(parts), None
        except OSError as e:
            yield url, None, None, str(e)


class HttpSource(DataSource):
    """Files behind links: ``spark.read.format("folio_http").option("urls", "...").load()`` after ``spark.dataSource.register(HttpSource)``."""

    @classmethod
    def name(cls) -> str:
        return "folio_http"

    def schema(self) -> str:
        return "url string, disposition string, content binary, error string"

    def reader(self, schema) -> HttpReader:
        return HttpReader(self.options)


def png(pixels: list[list[int]], broken: bool = False) -> bytes:
    """A small gray PNG, for fixtures and as the default image encoder."""
    rows = b"".join(b"\0" + bytes(r) for r in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    return out[:20] if broken else out


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, content) as files of a shared folder, given as a URI; rows (name, path, length).

    Written aside and moved, so that a file is whole or absent; names can't leave the folder.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        made: set[str] = set()
        for frame in frames:
            done = []
            for name, content in zip(frame["name"], frame["content"]):
                path = "/".join([base, *[p for p in name.split("/") if p not in ("", ".", "..")]])
                if (parent := path.rpartition("/")[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                aside = f"{path}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(aside) as f:
                    f.write(content)
                system.move(aside, path)
                done.append((name, path, len(content)))
            yield pd.DataFrame(done, columns=["name", "path", "length"])

    return df.select("name", "content").mapInPandas(run, "name string, path string, length long")


def shelf(key: Column) -> Column:
    """A folder for the files of 1,024 neighbouring numbers, as those of a whole table are too many for one."""
    return F.shiftright(key, 10).cast("string")


def written_folders(written: DataFrame, folder: str) -> DataFrame:
    """Write the files, now, of which ``write_files`` into the folder gives the rows; the folders (folder) that they are in."""
    inner = written.select(F.regexp_extract("name", r"(?s)^(.*)/", 1).alias("name")).distinct()
    return materialize(inner.select(F.concat(F.lit(f"{folder}/"), F.col("name")).alias("folder")))
