"""Source files as a table ``(project, path, content)``."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.files import is_ignored, language_of
from scanloom.plans.staging import staging

#: Bytes of content that one task reads on average, and that one batch of it holds.
READ_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Size that stands for a folder in a listing.
FOLDER = -1


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a full path (scheme and all), and the path inside it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    store = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    authority, _, path = rest.removeprefix("//").partition("/")
    system, base = pafs.FileSystem.from_uri(f"{store}://{authority}/")
    return system, f"{base.rstrip('/')}/{path}"


def source_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Every file below ``root`` as ``(path, size)``, ``path`` relative to it, whatever its name begins with.

    The folders of a level are rows that are dealt to the tasks, which list them; the level is written, and its folders
    are the rows of the next. A folder that the patterns of ``ignore`` and the built-in names cover is not gone into; without
    ``ignore`` none is left out. Links to folders are not followed.
    """
    staged, base = staging(spark, folder), _qualified(spark, root)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_store(base)
        local = isinstance(system, pafs.LocalFileSystem)
        for batch in batches:
            for at in batch.column("path").to_pylist():
                paths, sizes = [], []
                for entry in system.get_file_info(pafs.FileSelector(f"{top}/{at}".rstrip("/") or "/")):
                    inside = entry.type == pafs.FileType.Directory
                    if entry.type == pafs.FileType.File or (inside and not (local and os.path.islink(entry.path))):
                        paths.append(f"{at}/{entry.base_name}".lstrip("/"))
                        sizes.append(FOLDER if inside else entry.size or 0)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    folders, levels = spark.createDataFrame([("",)], "path string"), []
    while not folders.isEmpty():
        found = staged.stage(folders.repartition("path").mapInArrow(entries, "path string, size long"))
        levels.append(found.where(F.col("size") != FOLDER))
        folders = found.where(F.col("size") == FOLDER).select("path")
        if ignore is not None:
            folders = folders.where(~F.contains("path", F.lit("/")) | ~is_ignored(_after_first_slash(F.col("path")), ignore))
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files if ignore is None else files.where(~is_ignored(_after_first_slash(F.col("path")), ignore))


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """``(path, bytes)`` of the files of a listing, read by the tasks that ``path`` deals them to."""
    spark = files.sparkSession
    base = _qualified(spark, root)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_store(base)
        for batch in batches:
            paths, read, held = [], [], 0
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(f"{top}/{path}") as stream:
                    read.append(stream.read())
                paths.append(path)
                held += len(read[-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"path": paths, "bytes": pa.array(read, pa.binary())})
                    paths, read, held = [], [], 0
            if paths:
                yield pa.RecordBatch.from_pydict({"path": paths, "bytes": pa.array(read, pa.binary())})

    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    return files.select("path").repartition(tasks, "path").mapInArrow(contents, "path string, bytes binary")


def scan_source_files(
    spark: SparkSession, root: str, languages: list[str] | None = None, ignore: list[str] | None = None, folder: str | None = None
) -> DataFrame:
    """Every file below ``root``, which holds one directory per project; names that begin with a dot or an underscore too.

    With ``languages`` only files with an extension of theirs are opened, with ``ignore`` the folders and files it covers
    are passed over while the tree is listed. The listing is staged in ``folder`` or ``spark.checkpoint.dir``.
    """
    files = source_tree(spark, root, ignore, folder)
    if languages:
        files = files.where(language_of(F.col("path")).isin(languages))
    return read_contents(files, root).select(
        F.substring_index("path", "/", 1).alias("project"),
        _after_first_slash(F.col("path")).alias("path"),
        F.make_valid_utf8(F.col("bytes").cast("string")).alias("content"),
    )


def source_files_from_table(table: DataFrame, project: Column, path: Column, content: Column) -> DataFrame:
    """Any table with a text column as source files."""
    return table.select(project.alias("project"), path.alias("path"), content.alias("content"))


def _qualified(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme of its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _after_first_slash(text: Column) -> Column:
    return F.substring(text, F.locate("/", text) + 1, F.length(text))
