"""Archives, tables and plain files as DataFrames."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.office import pdf_text, sheets_of, sheets_text

MEMBERS = "archive string, file_path string, file_name string, file_extension string, raw_content binary, error string"


def read_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, content) of stored files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "content")


def zip_members(data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, error) of the members of an archive and, at any depth, of archives inside it, whose members stand under their path.

    One archive at each level is open at a time.
    """

    def opened(data: bytes) -> tuple[zipfile.ZipFile | None, str | None]:
        try:
            return zipfile.ZipFile(io.BytesIO(data)), None
        except zipfile.BadZipFile as e:
            return None, f"not an archive: {e}"

    archive, error = opened(data)
    if archive is None:
        yield "", None, error
        return
    todo = [("", archive, iter(archive.infolist()))]
    while todo:
        above, archive, members = todo[-1]
        info = next(members, None)
        if info is None:
            archive.close()
            todo.pop()
            continue
        if info.is_dir():
            continue
        path = above + info.filename
        try:
            content = archive.read(info)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
            yield path, None, str(e)
            continue
        if not path.lower().endswith(".zip"):
            yield path, content, None
            continue
        inner, error = opened(content)
        if inner is None:
            yield path, None, error
        else:
            todo.append((path + "/", inner, iter(inner.infolist())))


def archive_stem(name: str) -> str:
    """The name of an archive without its ending; ValueError for other names."""
    if not name.lower().endswith(".zip") or len(name) <= 4:
        raise ValueError(f"not the name of an archive: {name!r}")
    return name[:-4]


def read_archives(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Members of ZIP files, one a row; an archive that can't be opened gives one row with ``error``.

    A member at a time is handed on, so no more than one archive is open in a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, data in zip(pdf[path_col], pdf[content_col], strict=True):
                for path, content, error in zip_members(bytes(data)):
                    name = path.rsplit("/", 1)[-1]
                    ext = path.rsplit(".", 1)[-1] if "." in path else ""
                    yield pd.DataFrame([(archive, path, name, ext, content, error)], columns=["archive", "file_path", "file_name", "file_extension", "raw_content", "error"])

    return files.select(path_col, content_col).mapInPandas(run, MEMBERS)


def packages(members: DataFrame) -> DataFrame:
    """(archive, data_package_id, n_files): the id is made of name and sorted paths."""
    name = F.regexp_replace(F.element_at(F.split("archive", "/"), -1), r"\.zip$", "")
    return members.filter("error is null").groupBy("archive").agg(F.array_sort(F.collect_list("file_path")).alias("paths"), F.count("*").alias("n_files")).select("archive", T.package_id(name, F.col("paths")).alias("data_package_id"), "n_files")


def inventory(members: DataFrame, *also: str) -> DataFrame:
    """Members without their bytes, with size, type, and whether they can be chunked, and the columns named in ``also``."""
    kind = T.file_type("file_extension")
    return members.select("archive", "file_path", "file_name", "file_extension", F.length("raw_content").cast("long").alias("byte_size"), kind.alias("file_type"), (kind != "image").alias("is_chunkable"), "error", *also)


def rows_of_table(text: str) -> list[list[str]]:
    try:
        kind = csv.Sniffer().sniff(text, delimiters=",;\t|")
    except csv.Error:
        kind = csv.excel
    return list(csv.reader(io.StringIO(text), kind))


def is_number(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return False
    return True


def without_numeric_runs(rows: list[list[str]]) -> list[list[str]]:
    """Rows but those that are numeric, empty cells aside, and stand between two such rows."""
    flags = [all(is_number(c) for c in r if c.strip()) for r in rows]
    return [r for i, r in enumerate(rows) if not (flags[i] and 0 < i < len(rows) - 1 and flags[i - 1] and flags[i + 1])]


def text_of(content: bytes | None, file_name: str) -> str | None:
    """A file's text: tables as CSV under a heading and without their numeric runs, PDF pages one after the other, images as a placeholder, the rest decoded. ValueError where a file isn't what its name says."""
    if content is None:
        return None
    ext = file_name.rsplit(".", 1)[-1].lower() if "." in file_name else ""
    if ext in T.FILE_TYPES["image"]:
        return f"[image: {file_name}]"
    if ext in T.FILE_TYPES["pdf"]:
        return pdf_text(content)
    if ext in ("xlsx", "xlsm", "ods", "xls"):
        return sheets_text(sheets_of(content, ext), lambda rows: without_numeric_runs(rows))
    for coding in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            text = content.decode(coding)
            break
        except UnicodeDecodeError:
            continue
    return sheets_text([(file_name.split(".")[0], rows_of_table(text))], without_numeric_runs) if ext == "csv" else text


def with_text(members: DataFrame) -> DataFrame:
    """Members with ``text``; where a file can't be read that is null and ``error`` says why."""

    def f(content: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = []
        for c, n in zip(content, name, strict=True):
            try:
                rows.append((text_of(None if c is None else bytes(c), n), None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["text", "error"])

    made = members.withColumn("__t", F.pandas_udf(f, "text string, error string")("raw_content", "file_name"))
    return made.withColumn("text", F.col("__t.text")).withColumn("error", F.coalesce("error", F.col("__t.error"))).drop("__t")


def point_lookup(members: DataFrame, path: str) -> DataFrame:
    """The member at ``path``; ValueError where there is none."""
    found = members.filter(F.col("file_path") == path).limit(1)
    if found.isEmpty():
        raise ValueError(f"no file {path!r}")
    return found
