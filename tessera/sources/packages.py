"""ZIP packages as a Spark data source: one archive is read by many tasks, written by many, and followed as a stream.

``register(spark)``, then ``spark.read.format("package")``. The driver reads an
archive's central directory alone, one at a time, and keeps where its parts lie; a task
reads its part and the bytes of its members by offset, so no archive is ever held whole
and none is limited to the size of a cell. Options: ``path`` (an archive, or a folder with archives at any depth; any address that pyarrow's
file systems know), ``partitionBytes`` and ``partitionMembers`` (the most of a task), ``nested`` (true: archives
inside are opened, their members stand under their path), ``settle`` (seconds that a stream waits
before it takes a new archive).
"""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import ArrowInvalid, fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from tessera.sources.archives import MEMBERS, zip_members

#: most compressed bytes and members of a task
PARTITION_BYTES, PARTITION_MEMBERS = 64 << 20, 10_000
#: bytes that are inflated at once
PIECE = 1 << 20
#: most bytes (but for a single member) and members that are handed on at once
BATCH_BYTES, BATCH_MEMBERS = 4 << 20, 1_000
#: most members of an archive that is written; its directory is held until it is closed
ARCHIVE_MEMBERS = 10_000
ROWS = pa.schema([(c, pa.binary() if kind == "binary" else pa.string()) for c, kind in (x.split() for x in MEMBERS.split(", "))])
CONTENT = ROWS.get_field_index("raw_content")


@dataclass
class Member:
    path: str
    offset: int
    packed: int
    size: int
    method: int
    crc: int
    secret: bool


@dataclass
class Range(InputPartition):
    """A part of an archive's central directory, as place and length, and the bytes before the archive that its offsets leave out; ``error`` where it can't be opened."""

    archive: str
    at: int = 0
    length: int = 0
    shift: int = 0
    error: str | None = None


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


def _found(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def archives_of(path: str) -> list[fs.FileInfo]:
    """The archives at ``path``, by name; nothing hidden or unfinished."""
    store, at = _found(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = store.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[:1] in ("_", ".") for x in p[len(at) :].split("/"))
    return sorted((f for f in below if f.type == fs.FileType.File and f.path.lower().endswith(".zip") and not hidden(f.path)), key=lambda f: f.path)


def members_of(entries: bytes, shift: int = 0) -> list[Member]:
    """The members that a part of a central directory lists, folders left out."""
    # the part stands for a whole directory where an end follows it
    with zipfile.ZipFile(io.BytesIO(entries + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0, 0, len(entries), 0, 0))) as z:
        return [Member(i.filename, i.header_offset + shift, i.compress_size, i.file_size, i.compress_type, i.CRC, bool(i.flag_bits & 1)) for i in z.infolist() if not i.is_dir()]


def ranges(store: fs.FileSystem, archive: str, most_bytes: int, most_members: int) -> Iterator[Range]:
    """Parts of an archive's central directory; nothing else of it is read."""
    with store.open_input_file(archive) as f:
        try:
            z = zipfile.ZipFile(f)
        except (zipfile.BadZipFile, ArrowInvalid) as e:  # the second: a place before the beginning of a short file
            yield Range(archive, error=f"not an archive: {'File is not a zip file' if isinstance(e, ArrowInvalid) else e}")
            return
        f.seek(z.start_dir)
        entries = f.read()
    begin = end = held = n = shift = 0
    for info in z.infolist():
        after = end + 46 + sum(struct.unpack_from("<3H", entries, end + 28))
        if not info.is_dir():
            if n and (held + info.compress_size > most_bytes or n >= most_members):
                yield Range(archive, z.start_dir + begin, end - begin, shift)
                begin, held, n = end, 0, 0
            if not n:
                shift = info.header_offset - members_of(entries[end:after])[0].offset
            held += info.compress_size
            n += 1
        end = after
    if n:
        yield Range(archive, z.start_dir + begin, end - begin, shift)


def content_of(f, m: Member) -> bytes:
    """A member's bytes, read at its offset; ValueError where they aren't what the directory says."""
    if m.secret:
        raise ValueError("encrypted")
    f.seek(m.offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member at its offset")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(m.offset + 30 + name + extra)
    if m.method == zipfile.ZIP_STORED:
        out = f.read(m.packed)
    elif m.method in (zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        unpack, parts, left = zlib.decompressobj(-15) if m.method == zipfile.ZIP_DEFLATED else bz2.BZ2Decompressor(), [], m.packed
        try:
            while left > 0 and (raw := f.read(min(PIECE, left))):
                parts.append(unpack.decompress(raw))
                left -= len(raw)
            if m.method == zipfile.ZIP_DEFLATED:
                parts.append(unpack.flush())
        except (zlib.error, OSError, EOFError) as e:
            raise ValueError(str(e)) from e
        out = b"".join(parts)
    elif m.method == zipfile.ZIP_LZMA:
        raw = f.read(m.packed)
        size = struct.unpack("<H", raw[2:4])[0]
        spec = lzma._decode_filter_properties(lzma.FILTER_LZMA1, raw[4 : 4 + size])
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[spec]).decompress(raw[4 + size :])
    else:
        raise ValueError(f"unknown compression {m.method}")
    if len(out) != m.size or zlib.crc32(out) != m.crc:
        raise ValueError("bad checksum")
    return out


def rows_of(part: Range, path: str, nested: bool) -> Iterator[tuple]:
    """(archive, file_path, file_name, file_extension, raw_content, error) of a range."""

    def row(file_path: str, content: bytes | None, error: str | None) -> tuple:
        name = file_path.rsplit("/", 1)[-1]
        return part.archive, file_path, name, file_path.rsplit(".", 1)[-1] if "." in file_path else "", content, error

    if part.error:
        yield row("", None, part.error)
        return
    store, _ = _found(path)
    with store.open_input_file(part.archive) as f:
        f.seek(part.at)
        for m in members_of(f.read(part.length), part.shift):
            try:
                content = content_of(f, m)
            except ValueError as e:
                yield row(m.path, None, str(e))
                continue
            if nested and m.path.lower().endswith(".zip"):
                for inner, data, error in zip_members(content):
                    yield row(f"{m.path}/{inner}" if inner else m.path, data, error)
            else:
                yield row(m.path, content, None)


def batches_of(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of few bytes; Spark would hold thousands of members at once, as Python objects and again as a batch."""
    run: list[tuple] = []
    held = 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run, strict=True), ROWS, strict=True)], schema=ROWS)
    for row in rows:
        size = len(row[CONTENT] or b"")
        if run and (held + size > BATCH_BYTES or len(run) >= BATCH_MEMBERS):
            yield made()
            run, held = [], 0
        run.append(row)
        held += size
    if run:
        yield made()


class _Options:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a package needs a path")
        self.path = options["path"]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("partitionMembers", PARTITION_MEMBERS))
        self.nested = str(options.get("nested", "true")).lower() == "true"
        self.settle = float(options.get("settle", 2))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return batches_of(rows_of(part, self.path, self.nested))

    def ranges(self, archives: list[str]) -> list[Range]:
        store, _ = _found(self.path)
        return [r for a in archives for r in ranges(store, a, *self.most)]


class PackageReader(_Options, DataSourceReader):
    def partitions(self) -> list[Range]:
        # without any archive there is still one task, which has nothing to read
        return self.ranges([a.path for a in archives_of(self.path)]) or [Range("")]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.archive else iter(())


class PackageStream(_Options, DataSourceStreamReader):
    """New archives, by time of change and name; an offset is the last of them."""

    def initialOffset(self) -> dict:
        return {"changed": -1, "name": ""}

    def _all(self) -> list[tuple[int, str]]:
        until = time.time() - self.settle
        try:
            return sorted((a.mtime_ns, a.path) for a in archives_of(self.path) if a.mtime_ns <= until * 1e9)
        except FileNotFoundError:
            return []

    def latestOffset(self) -> dict:
        known = self._all()
        self.last = {"changed": known[-1][0], "name": known[-1][1]} if known else getattr(self, "last", self.initialOffset())
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Range]:
        after, upto = ((o["changed"], o["name"]) for o in (start, end))
        return self.ranges([name for changed, name in self._all() if after < (changed, name) <= upto])

    def commit(self, end: dict) -> None:
        pass


class PackageWriter(_Options, DataSourceArrowWriter):
    """Archives for each task, of at most ``ARCHIVE_MEMBERS`` members; none is seen before all are whole."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options)
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _unfinished(self) -> str:
        return f"{_found(self.path)[1]}/_unfinished-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, names, held = _found(self.path)[0], [], 0
        store.create_dir(self._unfinished(), recursive=True)
        with ExitStack() as opened:
            for batch in batches:
                # a member at a time leaves its batch; whole columns of Python objects would hold it twice
                for path, content in zip(batch.column("file_path"), batch.column("raw_content"), strict=True):
                    if not names or held == ARCHIVE_MEMBERS:
                        opened.close()
                        names.append(f"part-{uuid.uuid4().hex}.zip")
                        z = opened.enter_context(zipfile.ZipFile(opened.enter_context(store.open_output_stream(f"{self._unfinished()}/{names[-1]}")), "w", zipfile.ZIP_DEFLATED))
                        held = 0
                    # a fixed time, so that equal rows make equal archives
                    z.writestr(zipfile.ZipInfo(path.as_py()), bytes(content.as_py() or b""), zipfile.ZIP_DEFLATED)
                    held += 1
        return Written(tuple(names))

    def commit(self, messages: list[Written]) -> None:
        store, at = _found(self.path)
        old = [a.path for a in archives_of(self.path)] if self.overwrite and store.get_file_info(at).type != fs.FileType.NotFound else []
        store.create_dir(at, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{self._unfinished()}/{name}", f"{at}/{name}")
        for path in old:
            store.delete_file(path)
        self._clean()

    def abort(self, messages: list[Written]) -> None:
        self._clean()

    def _clean(self) -> None:
        store, _ = _found(self.path)
        if store.get_file_info(self._unfinished()).type != fs.FileType.NotFound:
            store.delete_dir(self._unfinished())


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> PackageReader:
        return PackageReader(self.options)

    def streamReader(self, schema) -> PackageStream:
        return PackageStream(self.options)

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        missing = {"file_path", "raw_content"} - set(schema.names)
        if missing:
            raise ValueError(f"a package's rows need {sorted(missing)}")
        return PackageWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackageSource)
