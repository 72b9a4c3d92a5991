"""Tiles as tables that read no more than they are asked for.

``tile_files`` reads ``folder/city/z/x/y.mvt``, ``tile_archive`` a single file
of tiles in order of the Hilbert curve with directories of their byte ranges.
Bounds of city, z, x and y reach both: of a folder only the files asked for
are opened, of an archive only its directories and the byte ranges of those
tiles are read. A read that fails is tried again after a wait that doubles.

Bounds are options of a table. With ``pushdown`` filters reach it as well, but Spark 4.1 keeps what was pushed with the
table: two scans of one such table in a query read by the filters of one of
them. Load a table for each scan there.
"""

from __future__ import annotations

import gzip
import json
import struct
import time
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.curve import first_of_zoom, stretches, tile_at
from ..functions.geo import tile_x, tile_y

#: Tries of a read, and seconds before the second one.
TRIES = 5
WAIT = 0.2
#: Folders of one x that a task reads, and bytes of an archive's tiles.
FOLDERS = 16
RANGE_BYTES = 32 << 20
#: Gaps of at most this between wanted tiles of an archive are read along.
GAP_BYTES = 32 << 10
LARGEST_ZOOM = 26
#: Tiles that a task holds at a time.
FETCHED_ROWS = 64

SCHEMA = "city string, z int, x int, y int, payload binary"


def file_bytes(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    """The bytes of a file, or a range of them."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        return f.read() if length is None else f.read_at(length, offset)


def listed(uri: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    system, path = fs.FileSystem.from_uri(uri)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def tried(read: Callable[..., bytes], *args, tries: int = TRIES, wait: float = WAIT) -> bytes:
    """``read``; after a failure again, and the last one's error where all fail. A file that isn't there isn't waited for."""
    for n in range(tries):
        try:
            return read(*args)
        except FileNotFoundError:
            raise
        except OSError:
            if n == tries - 1:
                raise
            time.sleep(wait * 2**n)
    raise ValueError("tries must be at least 1")


@dataclass
class Wanted:
    """What pushed filters leave: cities, and a first and last of z, x and y."""

    cities: set[str] | None = None
    low: dict[str, int] = field(default_factory=lambda: {"z": 0, "x": 0, "y": 0})
    high: dict[str, int] = field(default_factory=lambda: {"z": LARGEST_ZOOM, "x": 1 << LARGEST_ZOOM, "y": 1 << LARGEST_ZOOM})

    @classmethod
    def of(cls, options: dict[str, str]) -> Wanted:
        out = cls(set(json.loads(options["cities"])) if "cities" in options else None)
        for name in out.low:
            if name in options:
                out.low[name], out.high[name] = json.loads(options[name])
        return out

    def take(self, f: Filter) -> bool:
        """Whether a filter is wholly told by this from now on."""
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if name == "city" and isinstance(f, (EqualTo, In)):
            named = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.cities = named if self.cities is None else self.cities & named
            return True
        if name not in self.low:
            return False
        if isinstance(f, In) and f.value:  # a hull, and the filter stays
            self.low[name], self.high[name] = max(self.low[name], min(f.value)), min(self.high[name], max(f.value))
            return False
        if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
            self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
        if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
            self.high[name] = min(self.high[name], f.value - isinstance(f, LessThan))
        return isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan, LessThanOrEqual, LessThan))

    def has(self, name: str, value: int) -> bool:
        return self.low[name] <= value <= self.high[name]


class _Bounded(DataSourceReader):
    def __init__(self, options: dict[str, str], read: Callable[..., bytes]) -> None:
        self.options, self.read_bytes, self.wanted = options, read, Wanted.of(options)
        self.tries, self.wait = int(options.get("tries", TRIES)), float(options.get("wait", WAIT))

    def _bytes(self, *args) -> bytes:
        return tried(self.read_bytes, *args, tries=self.tries, wait=self.wait)


class _FolderReader(_Bounded):
    def partitions(self) -> list[InputPartition]:
        root, w = self.options["path"].rstrip("/"), self.wanted
        numbers = lambda at, name: [n for n in listed(at) if n.isdigit() and w.has(name, int(n))]
        cities = listed(root) if w.cities is None else sorted(w.cities)
        folders = [(city, int(z), int(x)) for city in cities for z in numbers(f"{root}/{city}", "z") for x in numbers(f"{root}/{city}/{z}", "x")]
        return [InputPartition(folders[i : i + FOLDERS]) for i in range(0, len(folders), FOLDERS)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root = self.options["path"].rstrip("/")
        for city, z, x in partition.value:
            for name in listed(f"{root}/{city}/{z}/{x}"):
                y, _, ending = name.partition(".")
                if ending == "mvt" and y.isdigit() and self.wanted.has("y", int(y)):
                    yield city, z, x, int(y), self._bytes(f"{root}/{city}/{z}/{x}/{name}")


def _pushed(reader: type[_Bounded]) -> type[_Bounded]:
    """The reader with filters pushed down to it, which Spark takes only where its setting allows it."""

    def push(self: _Bounded, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]

    return type("Pushed", (reader,), {"pushFilters": push})


class TileFiles(DataSource):
    """A folder of tile files. Options: path, tries, wait (seconds), cities (a JSON list), and z, x, y (JSON, the first and last)."""

    read_bytes = staticmethod(file_bytes)
    own_reader: type[_Bounded] = _FolderReader

    @classmethod
    def name(cls) -> str:
        return "tile_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = _pushed(self.own_reader) if self.options.get("pushdown") == "true" else self.own_reader
        return kind(dict(self.options), self.read_bytes)


# An archive: a head of HEAD bytes, the root directory, leaf directories, tiles. A directory is gzip of numbers in
# variable length, column by column: how many, steps of tile numbers, run lengths (0: a leaf), lengths, offsets
# plus 1 (0: right behind the one before). Fixed values of that public format:
MAGIC, VERSION, HEAD = b"PMTiles", 3, 127
GZIP = 2


@dataclass
class Entry:
    number: int
    run: int
    offset: int
    length: int


def _numbers(raw: bytes) -> Iterator[int]:
    value = shift = 0
    for byte in raw:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            yield value
            value = shift = 0


def directory(raw: bytes) -> list[Entry]:
    numbers = _numbers(gzip.decompress(raw))
    n = next(numbers)
    steps, runs, lengths, offsets = ([next(numbers) for _ in range(n)] for _ in range(4))
    out: list[Entry] = []
    at = 0
    for step, run, length, offset in zip(steps, runs, lengths, offsets):
        at += step
        out.append(Entry(at, run, offset - 1 if offset else out[-1].offset + out[-1].length, length))
    return out


def meeting(entries: list[Entry], wanted: list[tuple[int, int]]) -> Iterator[tuple[Entry, int, int]]:
    """Entries with the stretch of wanted numbers from a first to a last that they hold (of a leaf: may hold)."""
    firsts = [e.number for e in entries]
    for first, last in wanted:
        for k in range(max(0, bisect_right(firsts, first) - 1), len(entries)):
            e = entries[k]
            if e.number > last:
                break
            end = (entries[k + 1].number if k + 1 < len(entries) else 1 << 62) - 1 if e.run == 0 else e.number + e.run - 1
            if end >= first:
                yield e, max(first, e.number), min(last, end)


class _ArchiveReader(_Bounded):
    def _wanted(self, low: int, high: int) -> list[tuple[int, int]]:
        w, out = self.wanted, []
        for z in range(max(low, w.low["z"]), min(high, w.high["z"]) + 1):
            most = (1 << z) - 1
            x0, y0, x1, y1 = w.low["x"], w.low["y"], min(most, w.high["x"]), min(most, w.high["y"])
            if x0 == y0 == 0 and x1 == y1 == most:
                out.append((first_of_zoom(z), first_of_zoom(z + 1) - 1))
            elif x0 <= x1 and y0 <= y1:
                out += stretches(z, x0, y0, x1, y1)
        return out

    def partitions(self) -> list[InputPartition]:
        """Leaf directories that the wanted stretches may meet, each with its stretches; ranges of tiles that the root tells."""
        uri, city = self.options["path"], self.options.get("city", "")
        if self.wanted.cities is not None and city not in self.wanted.cities:
            return [InputPartition(None)]
        head = self._bytes(uri, 0, HEAD)
        if head[:7] != MAGIC or head[7] != VERSION or head[97] != GZIP:
            raise ValueError(f"{uri} is no archive of version {VERSION} with gzip directories")
        root_at, root_n, _, _, leaves_at, _, tiles_at, _ = struct.unpack("<8Q", head[8:72])
        root = directory(self._bytes(uri, root_at, root_n))
        found = list(meeting(root, self._wanted(head[100], head[101])))
        own, leaves = [x for x in found if x[0].run], {}
        for x in found:
            if not x[0].run:
                leaves.setdefault(x[0].offset, []).append(x)
        return [InputPartition((leaves_at, tiles_at, x)) for x in [*_by_bytes(own), *leaves.values()]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        uri, city = self.options["path"], self.options.get("city", "")
        leaves_at, tiles_at, todo = partition.value
        own, read = [], {}
        while todo:  # a leaf may have leaves
            e, first, last = todo.pop()
            if e.run:
                own.append((e, first, last))
                continue
            if e.offset not in read:
                read[e.offset] = directory(self._bytes(uri, leaves_at + e.offset, e.length))
            todo += meeting(read[e.offset], [(first, last)])
        for group in _runs(own):
            start, stop = group[0][0].offset, max(e.offset + e.length for e, _, _ in group)
            raw = self._bytes(uri, tiles_at + start, stop - start)
            for e, first, last in group:
                for number in range(first, last + 1):
                    z, x, y = tile_at(number)
                    yield city, z, x, y, raw[e.offset - start : e.offset - start + e.length]


def _by_bytes(found: list) -> Iterator[list]:
    group, held = [], 0
    for x in found:
        if group and held + x[0].length > RANGE_BYTES:
            yield group
            group, held = [], 0
        group.append(x)
        held += x[0].length
    if group:
        yield group


def _runs(found: list) -> Iterator[list]:
    """Entries whose bytes stand close together."""
    group, stop = [], 0
    for x in sorted(found, key=lambda x: x[0].offset):
        e = x[0]
        if group and (e.offset > stop + GAP_BYTES or e.offset + e.length - group[0][0].offset > RANGE_BYTES):
            yield group
            group, stop = [], 0
        group.append(x)
        stop = max(stop, e.offset + e.length)
    if group:
        yield group


class TileArchive(TileFiles):
    """One file of tiles. Options: those of ``TileFiles``, and city, the value of that column."""

    own_reader = _ArchiveReader

    @classmethod
    def name(cls) -> str:
        return "tile_archive"


def tile_table(spark: SparkSession, source: type[DataSource], path: str, cities: list[str] | None = None, z: tuple[int, int] | None = None, x: tuple[int, int] | None = None, y: tuple[int, int] | None = None, pushdown: bool = False, **options: object) -> DataFrame:
    """A table of the tiles within the bounds, ends included; with ``pushdown``, filters are bounds too."""
    spark.dataSource.register(source)
    bounds = {"cities": cities, "z": z, "x": x, "y": y}
    given = {k: json.dumps(v) for k, v in bounds.items() if v is not None} | {k: str(v) for k, v in options.items()}
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        given["pushdown"] = "true"
    # Where a query has nothing to push down, Spark would read by what the last query on this table has pushed.
    return spark.read.format(source.name()).options(**given).load(path).filter(F.col("z") >= 0)


def fetched(wanted: DataFrame, folder: str, read: Callable[..., bytes] = file_bytes, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """``wanted`` (city, z, x, y) with ``payload`` from ``folder/city/z/x/y.mvt``; tiles that aren't there are left out.

    Where the tiles are known one by one: nothing is listed, and no other file is opened.
    """
    target = pa.schema([("city", pa.string()), ("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("payload", pa.binary())])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FETCHED_ROWS):
                rows = []
                for tile in b.slice(at, FETCHED_ROWS).to_pylist():
                    try:
                        raw = tried(read, "{}/{city}/{z}/{x}/{y}.mvt".format(folder.rstrip("/"), **tile), tries=tries, wait=wait)
                    except FileNotFoundError:
                        continue
                    rows.append(tile | {"payload": raw})
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    ints = [F.col(c).cast("int").alias(c) for c in ("z", "x", "y")]
    return wanted.select("city", *ints).repartition("city", "z", "x", "y").mapInArrow(get, SCHEMA)


def tiles_of(spark: SparkSession, source: type[DataSource], path: str, city: str, zoom: int, box: list[float], **options: object) -> DataFrame:
    """A city's tiles that a west-south-east-north box touches."""
    w, s, e, n = (F.lit(float(v)) for v in box)
    x0, x1, y0, y1 = spark.range(1).select(tile_x(w, zoom), tile_x(e, zoom), tile_y(n, zoom), tile_y(s, zoom)).first()
    return tile_table(spark, source, path, [city], (zoom, zoom), (x0, x1), (y0, y1), city=city, **options)
