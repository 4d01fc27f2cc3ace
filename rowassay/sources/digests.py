"""SHA-256 of files too large for one task: a file's pieces are hashed one after the other, each by a task of its own."""

from __future__ import annotations

import ctypes
import hashlib
import re
from ctypes.util import find_library
from functools import cache
from importlib.util import find_spec

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BOM = b"\xef\xbb\xbf"
#: A line is held whole by its task; files with longer ones are not read in pieces.
LONGEST_LINE = 32 << 20


class _Context(ctypes.Structure):
    """``SHA256_CTX`` of libcrypto: numbers only, so its bytes can leave a task and be taken up by another."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint)]


class Digest:
    """A SHA-256 that goes on from the ``state`` of an earlier one."""

    def __init__(self, library: ctypes.CDLL, state: bytes | None = None):
        self._library = library
        self._context = _Context() if state is None else _Context.from_buffer_copy(state)
        if state is None:
            library.SHA256_Init(ctypes.byref(self._context))

    @property
    def state(self) -> bytes:
        return bytes(self._context)

    def update(self, data: pa.Buffer, size: int) -> None:
        self._library.SHA256_Update(ctypes.byref(self._context), ctypes.c_void_p(data.address), ctypes.c_size_t(size))

    def hexdigest(self) -> str:
        last, out = _Context.from_buffer_copy(self.state), ctypes.create_string_buffer(32)
        self._library.SHA256_Final(out, ctypes.byref(last))
        return out.raw.hex()


@cache
def libcrypto() -> ctypes.CDLL | None:
    """The library behind ``hashlib`` if a digest carried over by its state equals one in a single pass; else None."""
    data = bytes(range(251)) * 3
    for find in (lambda: find_spec("_hashlib").origin, lambda: find_library("crypto")):
        try:
            library = ctypes.CDLL(find() or "no library")
            first = Digest(library)
            first.update(pa.py_buffer(data[:99]), 99)
            second = Digest(library, first.state)
            second.update(pa.py_buffer(data[99:]), len(data) - 99)
        except (AttributeError, OSError):
            continue
        if second.hexdigest() == hashlib.sha256(data).hexdigest():
            return library
    return None


def literal_path(path: str) -> str:
    """The path as readers take it, with characters of patterns escaped."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _unpacked(spark: SparkSession, path: str) -> bool:
    """Whether the text scan unpacks the file and so does not give its raw bytes."""
    jvm = spark._jvm.org.apache.hadoop
    return jvm.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(jvm.fs.Path(path)) is not None


def _raw_lines(spark: SparkSession, path: str, longest: int) -> DataFrame:
    """The file's bytes in order, a line with its line feed in each row, and the split it starts in; a split is a partition.

    The reader passes over lines that are longer than ``longest`` by some bytes.
    """
    reader = spark.read.schema("value string").option("lineSep", "\n").option("mapreduce.input.linerecordreader.line.maxlength", longest + 64)
    line = F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\n"))).alias("line")
    return reader.text(literal_path(path)).select(line, F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"))


def _hashed_on(state: bytes, seen: int, size: int, longest: int):
    """Carry a digest of ``seen`` bytes on over one partition; bytes beyond ``size`` are only counted.

    A split holds the lines that start after its first byte and up to the first byte of the next split. A line that does not
    start there by the bytes before it shows that some were left out; there is no state then.
    """

    def run(batches):
        library = libcrypto()
        digest, total = library and Digest(library, state), seen
        for batch in batches:
            if not batch.num_rows or digest is None:
                continue
            lines = batch.column("line")
            start, length = (batch.column(name).to_numpy() for name in ("start", "length"))
            _, ends, data = lines.buffers()
            ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(lines.type) else np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
            first, n = int(ends[0]), int(ends[-1] - ends[0])
            at = total + ends[:-1] - first
            if (np.diff(ends) > longest).any() or ((at <= start) & (start > 0) | (at > start + length)).any():
                digest = None
                continue
            digest.update(data.slice(first), max(0, min(n, size - total)))
            total += n
        yield pa.RecordBatch.from_pydict({"state": pa.array([digest and digest.state], pa.binary()), "seen": pa.array([total], pa.int64())})

    return run


def _carried(spark: SparkSession, sizes: dict[str, int], head: bytes, longest: int) -> dict[str, tuple[bytes, int]]:
    """State and number of bytes after all pieces of each file; the k-th pieces of all files are one job."""
    scans = {path: _raw_lines(spark, path, longest) for path in sizes}
    pieces = {path: scan.rdd.getNumPartitions() for path, scan in scans.items()}
    begun = Digest(libcrypto())
    begun.update(pa.py_buffer(head), len(head))
    states = {path: (begun.state, len(head)) for path in sizes}
    for k in range(max(pieces.values(), default=0)):
        going = [path for path in states if k < pieces[path]]
        if not going:
            break
        steps = [scans[path].mapInArrow(_hashed_on(*states[path], sizes[path], longest), "state binary, seen bigint").rdd for path in going]
        before = np.cumsum([0, *[pieces[path] for path in going]])
        rows = spark.sparkContext.runJob(spark.sparkContext.union(steps), list, [int(n) + k for n in before[:-1]])
        states |= {path: (row.state and bytes(row.state), row.seen) for path, row in zip(going, rows, strict=True)}
        states = {path: kept for path, kept in states.items() if kept[0]}
    return states


def sha256_in_pieces(spark: SparkSession, sizes: dict[str, int], longest: int = LONGEST_LINE) -> dict[str, str]:
    """SHA-256 of the files that can be read in pieces, given their sizes; runs a job for each piece of the largest file.

    A digest is one chain over the bytes, so the pieces of a file follow one another, while files run side by side.
    Only the state of 112 bytes passes from task to task. Pieces are the splits of a text scan, so a task reads a split
    (``spark.sql.files.maxPartitionBytes`` at most) and the rest of its last line. The scan puts a line feed behind the last line and
    drops a byte order mark; both show in the number of bytes. Files that do not come back byte for byte (unpacked by their suffix, a line
    beyond ``longest``, changed meanwhile) have no digest here, nor has any where libcrypto does not carry one over.
    """
    left = {path: size for path, size in sizes.items() if libcrypto() and not _unpacked(spark, path)}
    digests = {}
    for head in (b"", BOM):
        states = _carried(spark, left, head, longest)
        digests |= {path: Digest(libcrypto(), state).hexdigest() for path, (state, seen) in states.items() if seen - left[path] in (0, 1)}
        left = {path: size for path, size in left.items() if path not in digests}
    return digests
