"""Archives read by byte ranges: what they hold, and some of it, without the rest.

`spark.read.format("ranged_zip")` splits archives by bytes as files are split: a partition is a range of an archive, and its task reads the entries whose headers
begin there. Tasks read ranges of blocks, of which each holds a few. Paths are http(s) addresses, or what pyarrow's file systems open.
"""

from __future__ import annotations

import os
import re
import struct
import urllib.request
import zipfile
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliant.sources.archives import ENTRIES

# Bytes of a block and blocks that are held, bytes that an entry's size is read from.
BLOCK, HELD, HEAD = 1 << 20, 8, 32 << 10
#: Bytes of an archive that one task reads the entries of.
PARTITION = 128 << 20
TIMEOUT = 60

Fetch = Callable[[int, int], bytes]


class RangedFile:
    """A file of which any bytes can be fetched, as a file that can be read and searched. It holds HELD blocks, the one not used for longest goes first.

    A read of a block or more goes past the blocks but for what it ends in; sample() reads exactly what is asked for and keeps nothing.
    """

    def __init__(self, fetch: Fetch, size: int, block: int = BLOCK, held: int = HELD) -> None:
        self.fetch, self.size, self.block, self.held = fetch, size, block, held
        self.at, self.fetched = 0, 0
        self.blocks: OrderedDict[int, bytes] = OrderedDict()

    def readable(self) -> bool:
        return True

    seekable = readable

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        base = {os.SEEK_SET: 0, os.SEEK_CUR: self.at, os.SEEK_END: self.size}
        if whence not in base:
            raise ValueError(f"no such whence: {whence}")
        self.at = min(max(0, base[whence] + offset), self.size)
        return self.at

    def read(self, n: int | None = -1) -> bytes:
        stop = self.size if n is None or n < 0 else min(self.size, self.at + n)
        out = []
        while self.at < stop:
            number, place = divmod(self.at, self.block)
            whole = (stop - self.at) // self.block * self.block
            if number not in self.blocks and whole and not place:
                part = self._get(self.at, self.at + whole)
            else:
                part = self._held(number)[place : place + stop - self.at]
            if not part:
                break
            out.append(part)
            self.at += len(part)
        return b"".join(out)

    def sample(self, offset: int, n: int) -> bytes:
        stop = min(self.size, offset + n)
        if offset < 0 or stop <= offset:
            return b""
        number, place = divmod(offset, self.block)
        if number in self.blocks and place + stop - offset <= len(self.blocks[number]):
            return self.blocks[number][place : place + stop - offset]
        return self._get(offset, stop)

    def close(self) -> None:
        self.blocks.clear()

    def _get(self, start: int, stop: int) -> bytes:
        data = self.fetch(start, stop)
        self.fetched += len(data)
        return data

    def _held(self, number: int) -> bytes:
        if number not in self.blocks:
            self.blocks[number] = self._get(number * self.block, min(self.size, (number + 1) * self.block))
            while len(self.blocks) > self.held:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(number)
        return self.blocks[number]


def http_range(url: str, start: int, stop: int, headers: dict[str, str]) -> tuple[bytes, str]:
    """(bytes start to stop, the range that the server says they are); anything but a partial answer is an error."""
    asked = urllib.request.Request(url, headers=headers | {"Range": f"bytes={start}-{stop - 1}", "Accept-Encoding": "identity"})
    with urllib.request.urlopen(asked, timeout=TIMEOUT) as answer:
        if answer.status != 206:
            raise OSError(f"{url} answered a range with {answer.status}")
        return answer.read(), answer.headers.get("Content-Range", "")


def whole_body(url: str, headers: dict[str, str], most: int) -> bytes:
    """A body of at most `most` bytes, for servers without ranges; a longer one is an error as soon as it is one."""
    parts, n = [], 0
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as answer:
        while part := answer.read(1 << 20):
            n += len(part)
            if n > most:
                raise OSError(f"{url} is longer than {most} bytes")
            parts.append(part)
    return b"".join(parts)


def probed_size(url: str, headers: dict[str, str]) -> int | None:
    """Bytes of what is at `url` if it gives ranges of it, by asking for the first byte."""
    try:
        _, said = http_range(url, 0, 1, headers)
    except OSError:
        return None
    told = re.search(r"bytes\s+\d+-\d+/(\d+)", said, re.I)
    return int(told[1]) or None if told else None


def is_http(path: str) -> bool:
    return path.lower().startswith(("http://", "https://"))


def open_ranged(path: str, headers: dict[str, str], most: int = 0) -> RangedFile:
    """The file at `path`; one that a server gives no ranges of is fetched whole, if it has at most `most` bytes."""
    if is_http(path):
        size = probed_size(path, headers)
        if size is not None:
            return RangedFile(lambda a, z: http_range(path, a, z, headers)[0], size)
        data = whole_body(path, headers, most)
        return RangedFile(lambda a, z: data[a:z], len(data))
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
    file = system.open_input_file(name)
    return RangedFile(lambda a, z: file.read_at(z - a, a), file.size())


def entry_head(file: RangedFile, entry: zipfile.ZipInfo) -> bytes | None:
    """The first bytes of a stored or deflated entry, from HEAD bytes of it; None if they can't be read."""
    header = file.sample(entry.header_offset, 30)
    if len(header) < 30 or entry.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None
    name, extra = struct.unpack("<HH", header[26:])
    data = file.sample(entry.header_offset + 30 + name + extra, min(HEAD, entry.compress_size))
    if entry.compress_type == zipfile.ZIP_STORED:
        return data
    try:
        return zlib.decompressobj(-15).decompress(data)
    except zlib.error:
        return None


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_ENTRIES = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ENTRIES.split(", ")])
_UNREADABLE = (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError, zlib.error)


class RangedZip(DataSource):
    """Options: `paths` (one a line, or load()'s path), `content` (all, head or none), `names` (of the entries wanted, one a line), `partitionbytes`, `most` (bytes of a body without ranges), `header.<name>`."""

    @classmethod
    def name(cls) -> str:
        return "ranged_zip"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split("\n") if p]
        self.content, self.size, self.most = options.get("content", "all"), int(options.get("partitionbytes", PARTITION)), int(options.get("most", 0))
        self.headers = {k.split(".", 1)[1]: v for k, v in options.items() if k.lower().startswith("header.")}
        self.names = set(options["names"].split("\n")) if "names" in options else None

    def partitions(self) -> list[Split]:
        out = []
        for path in self.paths:
            try:
                size = open_ranged(path, self.headers, self.most).size
            except OSError:  # no rows, as for an archive that can't be read
                continue
            out += [Split(path, a, a + self.size) for a in range(0, max(1, size), self.size)]
        return out or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        file = open_ranged(split.path, self.headers, self.most)
        try:
            archive = zipfile.ZipFile(file)
        except (zipfile.BadZipFile, OSError):
            return
        for i, e in enumerate(archive.infolist()):
            if e.is_dir() or not split.start <= e.header_offset < split.stop or (self.names is not None and e.filename not in self.names):
                continue
            content = None
            if self.content != "none":
                try:
                    content = entry_head(file, e) if self.content == "head" else archive.read(e)
                except _UNREADABLE:
                    pass
            row = (split.path, i, e.filename, e.file_size, e.compress_size, e.compress_type, e.header_offset, content)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ENTRIES)], schema=_ENTRIES)


def read_ranged(spark: SparkSession, paths: list[str], names: list[str] | None = None, **options: str | int) -> DataFrame:
    """The entries of archives (those of `names`, if given), by ranges; see RangedZip. An archive that can't be read gives no rows, an entry that can't has a null content."""
    spark.dataSource.register(RangedZip)
    return spark.read.format("ranged_zip").options(paths="\n".join(paths), **({} if names is None else {"names": "\n".join(names)}), **options).load()
