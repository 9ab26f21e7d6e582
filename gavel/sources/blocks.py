"""Large CSV files with quoted newlines, read in many tasks.

A newline ends a record only outside of quotes, so a block of a file cannot know
by itself where its records start. It can count its quotes, though, and its
record starts for either case. The parity of the quotes before a block, a running
sum over one row a block, then decides, and gives the number of every block's
first record as well. Each block is parsed from its first true record start to the
end of its last record, which it reads on for.
"""

from __future__ import annotations

import csv
import io
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators.items import ROW_INDEX
from gavel.schemas import require
from gavel.session import checked_broadcast, materialize

BLOCK = 32 << 20
TASKS = 100_000  # tasks of a pass at most; each takes the blocks of its range
SPREAD = 256  # tasks that small blocks are dealt to at least
AHEAD = 1 << 20  # read at a time beyond a block at most, for the rest of its last record
QUOTE, NEWLINE, RETURN = 34, 10, 13
BOM = b"\xef\xbb\xbf"


def uri(path: str) -> str:
    """A path as the URI of its file system; Hadoop's `file:/x` and plain paths are local."""
    local = path.removeprefix("file://").removeprefix("file:")
    return local if "://" in local else f"file://{local}"


def open_file(path: str):
    """A file for ranged reads, through Arrow's file systems."""
    import pyarrow.fs as pafs

    filesystem, name = pafs.FileSystem.from_uri(uri(path))
    return filesystem.open_input_file(name)


def open_output(path: str):
    """A new file to be written, with the folders above it."""
    import pyarrow.fs as pafs

    filesystem, name = pafs.FileSystem.from_uri(uri(path))
    filesystem.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return filesystem.open_output_stream(name)


def files_of(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[str, int]]:
    """(path, size) of the files behind paths, patterns or folders, sorted within each; hidden and empty ones are left out."""
    found = []
    for one in [path] if isinstance(path, str) else path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(one)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        files = []
        for status in fs.globStatus(hadoop) or []:
            inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            files += [s for s in inside if s.isFile() and s.getPath().getName()[0] not in "._"]
        if not files:
            raise FileNotFoundError(f"source not found: {one}")
        found += sorted((s.getPath().toString(), s.getLen()) for s in files)
    return [(p, size) for p, size in found if size]


def parities(data: bytes) -> np.ndarray:
    """For every byte whether an odd number of quotes ends there."""
    return np.bitwise_xor.accumulate((np.frombuffer(data, np.uint8) == QUOTE).view(np.uint8))


def _blank(units: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the places begin an empty line; `units` ends two bytes behind the last place or with the file."""
    following = np.append(units, np.zeros(2, np.uint8))
    return (following[places] == NEWLINE) | ((following[places] == RETURN) & (following[places + 1] == NEWLINE))


def record_starts(data: bytes, size: int, parity: int, first: bool) -> np.ndarray:
    """Where records start: behind the newlines among the first `size` bytes that lie outside of quotes.

    `parity` is that of the quotes before `data`. The first block also starts one
    at its first byte, behind a byte order mark. Empty lines are no records.
    """
    units = np.frombuffer(data, np.uint8)
    outside = parities(data[:size]) == parity
    places = np.flatnonzero((units[:size] == NEWLINE) & outside) + 1
    if first:
        places = np.insert(places, 0, len(BOM) if data.startswith(BOM) else 0)
        places = places[places < len(units)]
    return places[~_blank(units, places)]


class Block:
    """Bytes [start, end) of a file. Its records are those that start there.

    The newlines that decide on them are one byte before, so `data` begins at the
    byte before the block (but in the file's first one), and `size` of its bytes
    are the block's share of the newlines.
    """

    def __init__(self, path: str, total: int, number: int, block: int):
        self.path, self.total = path, total
        self.start, self.end = number * block, min((number + 1) * block, total)
        self.first, self.last = number == 0, self.end == total
        self.begin = self.start if self.first else self.start - 1
        self.size = self.end - 1 - self.begin

    def count(self) -> tuple[int, int, int]:
        """Quotes of the share (of all, in the last block), and records for even and for odd quotes before."""
        with open_file(self.path) as file:
            file.seek(self.begin)
            data = file.read(self.end + 1 - self.begin)
        quotes = (data if self.last else data[: self.size]).count(b'"')
        return quotes, *(len(record_starts(data, self.size, parity, self.first)) for parity in (0, 1))

    def records(self, parity: int) -> list[bytes]:
        """The block's first record, and all its further ones with the rest of the last; no bytes without records."""
        with open_file(self.path) as file:
            file.seek(self.begin)
            data = file.read(self.end + 1 - self.begin)
            starts = record_starts(data, self.size, parity, self.first)
            if not len(starts):
                return [b"", b""]
            parts, seen, odd = [data], len(data), int(parities(data)[-1]) ^ parity
            end = self._end(data, self.size, parity)
            ahead = min(AHEAD, self.end - self.start)
            while end is None and self.begin + seen < self.total:
                more = file.read(ahead)
                ahead = min(AHEAD, 2 * ahead)
                end = self._end(more, 0, odd)
                end = None if end is None else seen + end
                parts.append(more)
                seen, odd = seen + len(more), odd ^ int(parities(more)[-1])
        data = b"".join(parts)[:end]
        second = int(starts[1]) if len(starts) > 1 else len(data)
        return [data[int(starts[0]) : second], data[second:]]

    @staticmethod
    def _end(data: bytes, at: int, parity: int) -> int | None:
        """The end of the record that byte `at` belongs to, if it lies in `data`."""
        units = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero((units[at:] == NEWLINE) & (parities(data)[at:] == parity))
        return at + int(ends[0]) + 1 if len(ends) else None


def blocks_of(spark: SparkSession, count: int, size: int = BLOCK) -> DataFrame:
    """`id` from 0 to count - 1, for pieces of `size` bytes: a task for each up to SPREAD, then for BLOCK bytes, up to TASKS."""
    tasks = max(min(count, SPREAD), min(-(-count * size // BLOCK), count, TASKS))
    return spark.range(0, count, 1, max(1, tasks))


def _fields(record: bytes, sep: str) -> list[str]:
    text = record.removeprefix(BOM).decode()
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])


def block_starts(spark: SparkSession, files: Sequence[tuple[str, int]], block: int = BLOCK) -> DataFrame:
    """One row a block: id, file, number, parity (of the quotes before it), header (whether its first record is one), n (records but the header) and offset (records of all blocks before it)."""
    sizes = [-(-size // block) for _, size in files]
    firsts = [0, *np.cumsum(sizes).tolist()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in batch.column("id").to_pylist():
                file = bisect_right(firsts, at) - 1
                number = at - firsts[file]
                rows.append((at, file, number, *Block(*files[file], number, block).count()))
            names = ("id", "file", "number", "quotes", "even", "odd")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], list(names))

    counted = blocks_of(spark, firsts[-1], block).mapInArrow(
        count, "id LONG, file LONG, number LONG, quotes LONG, even LONG, odd LONG"
    )
    counted = materialize(counted, "csv-blocks")
    before = "ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    seen = counted.selectExpr(
        "*", f"coalesce(sum(quotes) OVER (PARTITION BY file {before}), 0) % 2 AS parity",
        "sum(quotes) OVER (PARTITION BY file) % 2 AS open",
    )
    names = F.array(*[F.lit(path) for path, _ in files])
    message = F.concat(F.lit("quotes do not match up: "), F.get(names, F.col("file").cast("int")))
    seen = require(seen, F.col("open") == 0, message).withColumn("n", F.expr("if(parity = 0, even, odd)"))
    headed = seen.selectExpr("*", f"n > 0 AND coalesce(sum(n) OVER (PARTITION BY file {before}), 0) = 0 AS header")
    own = headed.selectExpr("id", "file", "number", "parity", "header", "n - int(header) AS n")
    # One row a block in this window, whatever the records.
    return own.selectExpr("*", f"coalesce(sum(n) OVER ({before}), 0) AS offset")


def read_csv_blocks(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", block: int = BLOCK
) -> DataFrame:
    """CSV files with header rows as strings, with `row_index` over all files in path order.

    An empty field is NULL, an empty quoted one is an empty text. Every file has
    the header of the first. A record with another number of fields, quotes that
    do not match up and text that is not UTF-8 fail the job. Quotes count
    wherever they stand: a file with a quote inside an unquoted field needs the
    unsplit `read_csv`, and fails here. A block with its longest record must fit
    a task's memory. One pass counts (when this is called), one parses.
    """
    import pyarrow.csv as pacsv

    if block < 4:
        raise ValueError("a block holds a byte order mark at least")
    files = files_of(spark, path)
    if not files:
        raise ValueError(f"source without a header: {path}")
    with open_file(files[0][0]) as file:
        data = file.read(AHEAD)
        while len(starts := record_starts(data, len(data), 0, True)) < 2 and (more := file.read(AHEAD)):
            data += more
    if not len(starts):
        raise ValueError(f"source without a header: {files[0][0]}")
    header = _fields(data[starts[0] : starts[1] if len(starts) > 1 else None], sep)
    names = _unique(header)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reads = pacsv.ParseOptions(delimiter=sep, newlines_in_values=True)
        columns = pacsv.ConvertOptions(
            column_types={n: pa.string() for n in names}, strings_can_be_null=True,
            quoted_strings_can_be_null=False, null_values=[""],
        )
        for batch in batches:
            for row in batch.to_pylist():
                place = Block(*files[row["file"]], row["number"], block)
                first, rest = place.records(row["parity"])
                if row["header"]:
                    if _fields(first, sep) != header:
                        raise ValueError(f"another header than the first file's: {place.path}")
                    first = b""
                body = first + rest
                if not row["n"]:
                    continue
                whole = pacsv.ReadOptions(column_names=names, block_size=len(body) + 1, use_threads=False)
                table = pacsv.read_csv(io.BytesIO(body), whole, reads, columns)
                if table.num_rows != row["n"]:
                    raise ValueError(f"quotes inside unquoted fields, read it unsplit: {place.path}")
                index = pa.array(np.arange(row["offset"], row["offset"] + row["n"]), pa.int64())
                yield from table.append_column(ROW_INDEX, index).to_batches(max_chunksize=10_000)

    starts = materialize(block_starts(spark, files, block), "csv-starts")
    known = blocks_of(spark, starts.count(), block).join(checked_broadcast(starts, 1_000_000), "id")
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    return known.mapInArrow(parse, f"{schema}, {ROW_INDEX} LONG")


def _unique(header: Sequence[str]) -> list[str]:
    """Column names: an empty one by its place, repeated ones (in any case) with their place."""
    lower = [h.lower() for h in header]
    return [f"_c{i}" if not h else h if lower.count(h.lower()) == 1 else f"{h}{i}" for i, h in enumerate(header)]


def splittable(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether blocks of the files can be read: plain files of a file system that Arrow knows."""
    import pyarrow.fs as pafs

    files = files_of(spark, path)
    if any(p.rsplit(".", 1)[-1].lower() in ("gz", "bz2", "zst", "lz4", "snappy", "xz", "deflate") for p, _ in files):
        return False
    try:
        for known in {uri(p).split("://")[0]: uri(p) for p, _ in files}.values():
            pafs.FileSystem.from_uri(known)
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return False
    return bool(files)
