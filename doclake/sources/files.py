"""Text files and directories as documents, and the per-file report."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.functions.cleaning import clean_markdown
from doclake.session import stored

# Patterns for directory reads.
INCLUDE = ["*.md", "*.txt", "*.rst", "*.py", "*.js", "*.ts", "*.html", "*.json"]
EXCLUDE = ["*.pyc", "__pycache__", ".git", ".venv", "node_modules", "*.log", ".DS_Store", "*.tmp", "dist", "build"]
TOOL_INCLUDE = [*INCLUDE, "*.yaml", "*.yml"]
TOOL_EXCLUDE = [*EXCLUDE, ".env"]


def safe_file_name(name: Column) -> Column:
    """Invalid characters and blanks become underscores, runs collapse, ends are trimmed; nothing left is untitled."""
    safe = F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
    safe = F.regexp_replace(F.regexp_replace(safe, r"[ \t]+", "_"), r"_{2,}", "_")
    safe = F.regexp_replace(safe, r"\A[_.]+|[_.]+\z", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("untitled"))


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, else Latin-1, which every byte sequence is. Line ends become ``\\n``."""
    utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def _plain_path(path: Column) -> Column:
    """Local paths without their scheme; a path of any other file system keeps it."""
    return F.regexp_replace(path, r"^file:/*", "/")


def _url(path: Column) -> Column:
    return F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), path).otherwise(F.concat(F.lit("file://"), path))


def _shape(files: DataFrame) -> DataFrame:
    """Binary files to documents; one file is one row, decoded and cleaned where it was read."""
    path = _plain_path(F.col("path"))
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = F.left(name, F.length(name) - F.length(extension))
    text = decode_text(F.col("content"))
    markdown = F.lower(extension).isin(".md", ".markdown")
    shaped = files.select(
        _url(path).alias("url"),
        safe_file_name(stem).alias("title"),
        F.when(markdown, clean_markdown(text)).otherwise(text).alias("content"),
        path.alias("source_file"),
        F.lit("file").alias("source_type"),
        F.col("length").alias("file_size"),
        extension.alias("file_extension"),
        F.col("modificationTime").alias("modified_at"),
    )
    return shaped.withColumn("content_length", F.length("content"))


def _qualified(spark: SparkSession, root: str) -> str:
    """The root with the scheme of its file system, without a slash at its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full).rstrip("/")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a directory, one ``path`` a row, whatever its name starts with.

    Folders are listed level by level in the tasks, and each level is written before the next; no list of files comes to the
    driver. Spark's own sources would leave out names that start with "_" or ".".
    """

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(_uri(folder))
                found = system.get_file_info(fs.FileSelector(name, allow_not_found=True))
                paths = [f"{folder}/{info.base_name}" for info in found]
                folders = [info.type == fs.FileType.Directory for info in found]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], ["path", "folder"])

    level = spark.createDataFrame([(_qualified(spark, root),)], "path string")
    files = None
    while True:
        spread_out = level.repartition(F.col("path"))
        listed = stored(spread_out.mapInArrow(children, "path string, folder boolean"), "listing")
        here = listed.where("not folder").select("path")
        files = here if files is None else files.unionByName(here)
        level = listed.where("folder").select("path")
        if level.isEmpty():
            return files


def _uri(path: str) -> str:
    """A path as a URI: what a URI reserves is escaped, the scheme and slashes stay."""
    scheme, _, rest = path.partition("://")
    return f"{scheme}://{quote(rest)}"


def _read_bytes(paths: DataFrame) -> DataFrame:
    """Files (path) with length, modificationTime and content, read in the tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(_uri(path))
                info = system.get_file_info(name)
                with system.open_input_stream(name) as stream:
                    data = stream.read()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path]),
                        pa.array([len(data)], pa.int64()),
                        pa.array([info.mtime], pa.timestamp("us", "UTC")),
                        pa.array([data], pa.binary()),
                    ],
                    names=["path", "length", "modificationTime", "content"],
                )

    return paths.mapInArrow(read, "path string, length long, modificationTime timestamp, content binary")


def _any_glob(column: Column, patterns: list[str]) -> Column:
    regexes = [fnmatch.translate(p).replace(r"\Z", r"\z") for p in patterns]
    return reduce(lambda a, b: a | b, [column.rlike(rf"\A{r}") for r in regexes], F.lit(False))


def select_files(
    files: DataFrame,
    root: str,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    prune_dirs: bool = False,
) -> DataFrame:
    """Files (column ``path``) that no exclude pattern and some include pattern matches.

    Excludes are tried on the file name and on the path relative to the root, includes on the name. A pattern such as
    "node_modules" therefore does not cover the files *below* that directory; ``prune_dirs`` makes it do so.
    """
    path = F.regexp_replace("path", "^file:/+", "file:///")
    relative = F.substring(path, len(root.rstrip("/")) + 2, 2**31 - 1)
    name = F.element_at(F.split(path, "/"), -1)
    exclude = EXCLUDE if exclude is None else exclude
    excluded = _any_glob(name, exclude) | _any_glob(relative, exclude)
    if prune_dirs:
        parents = F.slice(F.split(relative, "/"), F.lit(1), F.size(F.split(relative, "/")) - 1)
        excluded = excluded | F.exists(parents, lambda d: _any_glob(d, exclude))
    return files.where(~excluded & _any_glob(name, INCLUDE if include is None else include))


def read_directory(
    spark: SparkSession,
    root: str,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    max_files: int | None = None,
    prune_dirs: bool = False,
) -> DataFrame:
    """Text files below a directory as documents.

    Everything below the root is listed, and the patterns alone decide what is read; names are names, never patterns.
    With ``max_files`` the first paths by order are read.
    """
    home = _qualified(spark, root)
    chosen = select_files(list_files(spark, home), home, include, exclude, prune_dirs)
    if max_files is not None:
        chosen = chosen.orderBy("path").limit(max_files)
    return _shape(_read_bytes(chosen.repartition(F.col("path"))))


def _glob_regex(pattern: str) -> str:
    """A path pattern of *, ?, [...] and {a,b} as a regular expression."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            out, i = out + "[" + pattern[i:end].replace("!", "^", 1) + "]", end + 1
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        else:
            out += "|" if c == "," and depth else re.escape(c)
    return f"^{out}$"


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text files as documents (url, title, content, source_file, file_size, ...).

    A path is a file, a folder (the files directly in it) or a pattern. Names that start with "_" or "." are read like others.
    """
    chosen = None
    for given in [paths] if isinstance(paths, str) else paths:
        fixed = re.split(r"/[^/]*[*?\[{]", given, maxsplit=1)[0]
        path = _qualified(spark, fixed)
        if fixed != given:
            found = list_files(spark, path).where(F.col("path").rlike(_glob_regex(path + given[len(fixed) :])))
        elif _is_folder(spark, path):
            found = list_files(spark, path).where(F.col("path").rlike(f"^{re.escape(path)}/[^/]+$"))
        else:
            found = spark.createDataFrame([(path,)], "path string")
        chosen = found if chosen is None else chosen.unionByName(found)
    if chosen is None:
        raise ValueError("no path is given")
    return _shape(_read_bytes(chosen.distinct().repartition(F.col("path"))))


def _is_folder(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder).isDirectory()


def file_report(results: DataFrame) -> DataFrame:
    """Totals over per-file results (file, status): processed, failed (skipped files count as failed), total."""
    processed = F.col("status") == "processed"
    return results.agg(
        F.count_if(processed).alias("processed_files"),
        F.count_if(~processed).alias("failed_files"),
        F.count_if(F.col("status") == "skipped").alias("skipped_files"),
        F.count("*").alias("total_files"),
    )
