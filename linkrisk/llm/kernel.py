"""Shared numeric kernels: word spans and hashes straight from Arrow buffers.

Everything works on the UTF-8 bytes of an Arrow string column, so no Python
object is made for a word.  All separators are ASCII, hence byte classes are
exact for UTF-8.  Memory is bounded by the piece of rows handed in (see
:func:`pieces`); one single very long text is its own piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text that one vectorised step handles.
PIECE = 2 << 20

_ALL = np.arange(256)
#: A-Z to a-z, everything else as it is.
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
SAME = _ALL.astype(np.uint8)
#: Bytes of ``[^\x20\x09-\x0D]+`` words.
NON_SPACE = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` words (after lower-casing).
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)

#: Odd multipliers, one for each seed.
_BASE = {0: 0x9E3779B97F4A7C15, 1: 0xD6E8FEB86659FD93}
#: Spans of more bytes than this are hashed and compared one by one.
_LONG = 64
#: Masks of the lowest 0 to 8 bytes.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def _runs(kinds: np.ndarray) -> list[tuple[np.uint8, np.uint8, np.uint8]]:
    """(kind, first byte, how many more) of each run of bytes of one kind that is not zero."""
    edges = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
    return [(np.uint8(kinds[i]), np.uint8(i), np.uint8(j - i - 1)) for i, j in zip(edges, edges[1:]) if kinds[i]]


def mapped(raw: np.ndarray, mapping: np.ndarray) -> np.ndarray:
    """``mapping[raw]``, one step for each run of bytes that are moved equally far."""
    out = raw.copy()
    for step, first, more in _runs(mapping - SAME):
        out += (raw - first <= more).view(np.uint8) * step
    return out


def marked(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """``kind[data]`` of a mask of bytes, one step for each of its runs."""
    yes, no = _runs(kind.view(np.uint8)), _runs((~kind).view(np.uint8))
    out = np.zeros(len(data), bool)
    for _, first, more in min(yes, no, key=len):
        out |= data - first <= more
    return out if len(yes) <= len(no) else ~out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: For each seed: what the hash of a span of 0, 1, ... bytes begins with.
_BEGIN = {seed: mix(np.arange(_LONG + 1, dtype=U64) + U64(base)) for seed, base in _BASE.items()}


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if not len(column) or offs is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take at most ``limit`` bytes, or one longer row."""
    sizes = np.diff(buffers(batch.column(text))[1])
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Word spans of a column of texts.

    start, end: byte spans of all words; first: for each row, the index of its
    first word (one entry more than rows); data: the mapped bytes.
    """

    def __init__(self, column, word_bytes: np.ndarray, mapping: np.ndarray = SAME):
        raw, self.offsets = buffers(column)
        self.data = raw if mapping is SAME else mapped(raw, mapping)
        inside = marked(self.data, word_bytes)
        n = len(inside)
        bounds = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        bounds = np.concatenate([[0] if n and inside[0] else [], bounds, [n] if n and inside[-1] else []]).astype(np.int64)
        self.start, self.end = bounds[::2].copy(), bounds[1::2].copy()
        edge = np.unique(self.offsets[(self.offsets > 0) & (self.offsets < n)])  # a row's edge always parts words
        edge = edge[inside[edge - 1] & inside[edge]]
        if len(edge):
            self.start = np.insert(self.start, np.searchsorted(self.start, edge), edge)
            self.end = np.insert(self.end, np.searchsorted(self.end, edge), edge)
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end, seed)

    def room(self) -> np.ndarray:
        """For each word: how many words its row has from here on, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def word_ids(words: Words) -> np.ndarray:
    """A number for each word, equal for equal bytes, in order of first sight."""
    bounds = np.empty(2 * len(words) + 1, np.int32)
    bounds[0:-1:2], bounds[1::2], bounds[-1] = words.start, words.end, len(words.data)
    blob = pa.BinaryArray.from_buffers(pa.binary(), 2 * len(words), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(words.data))])
    return blob.take(pa.array(np.arange(0, 2 * len(words), 2))).dictionary_encode().indices.to_numpy().astype(np.int64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as numbers (zeros after the end)."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", wide, 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span.

    Eight bytes at a time are mixed in, so spans of one length up to eight bytes
    never share a hash; spans over 64 bytes take XXH64.
    """
    import xxhash

    length = end - start
    out = _BEGIN[seed].take(length, mode="clip")
    eights = _eights(data)
    long = length > _LONG
    at, done = np.flatnonzero(~long & (length > 0)), 0
    if length.all():  # the first step of all spans at a time
        out = mix(out ^ (eights[start] & _LOW.take(length, mode="clip")))
        at, done = at[length[at] > 8], 8
    while len(at):
        left = length[at] - done
        out[at] = mix(out[at] ^ (eights[start[at] + done] & _LOW[np.minimum(left, 8)]))
        at = at[left > 8]
        done += 8
    if long.any():
        view = memoryview(np.ascontiguousarray(data))
        for i in np.flatnonzero(long).tolist():
            out[i] = xxhash.xxh64_intdigest(view[int(start[i]) : int(end[i])], seed)
    return out


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from a_start in a and from b_start in b are the same."""
    out = np.ones(len(length), bool)
    left, right = _eights(a), _eights(b)
    long = length > _LONG
    at, done = np.flatnonzero(~long & (length > 0)), 0
    while len(at):
        rest = length[at] - done
        out[at] &= ((left[a_start[at] + done] ^ right[b_start[at] + done]) & _LOW[np.minimum(rest, 8)]) == 0
        at = at[(rest > 8) & out[at]]
        done += 8
    for i in np.flatnonzero(long).tolist():
        n = int(length[i])
        out[i] = np.array_equal(a[int(a_start[i]) : int(a_start[i]) + n], b[int(b_start[i]) : int(b_start[i]) + n])
    return out


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k values; windows over the end are left out.

    Runs of powers of two are put together pairwise, each time through the finaliser.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    base = U64(_BASE[seed])
    total, taken, run, width = None, 0, h, 1
    left = k
    while left:
        if left & 1:
            part = run[taken : taken + n]
            total = part if total is None else mix(total * base + part)
            taken += width
        left >>= 1
        if left:
            run = mix(run[: len(run) - width] * base + run[width:])
            width *= 2
    return mix(total + U64(k))


class Lookup:
    """Places of 64-bit hashes in a sorted array, found from their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(22, max(1, len(keys).bit_length()))
        self.shift = U64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << self.shift).astype(np.int32)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those that are not there."""
        if not len(self.keys) or not len(wanted):
            return np.full(len(wanted), -1, np.int64)
        last = len(self.keys) - 1
        at = np.minimum(self.first[(wanted >> self.shift).astype(np.int64)], last).astype(np.int64)
        short = np.flatnonzero(self.keys[at] < wanted)
        while len(short):
            short = short[at[short] < last]
            at[short] += 1
            short = short[self.keys[at[short]] < wanted[short]]
        at[self.keys[at] != wanted] = -1
        return at


def trim() -> None:
    """Gives freed memory back to the system, so that a reused worker does not carry one step's peak into the next."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def extended(df: DataFrame, text: str, fields: Sequence[T.StructField], make: Callable[[], Callable], carry: Sequence[str] | None = None, limit: int = PIECE) -> DataFrame:
    """``df`` (its columns in ``carry``, or all) with columns computed per row.

    make() runs once in each task and returns a function from a string column
    to one Arrow array per field.  A column of ``df`` with the name of a new
    field is replaced.  Columns have names of their own on the way, so that none
    can clash.
    """
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new and (carry is None or f.name in carry)]
    given = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(keep)]
    made = [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)]
    df = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    names = [f.name for f in (*given, *made)]

    def run(batches):
        fn = make()
        for batch in batches:
            for piece in pieces(batch, "t", limit):
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(len(given))], *fn(piece.column(len(given)))], names=names)
        trim()

    return df.mapInArrow(run, T.StructType([*given, *made])).toDF(*[f.name for f in (*keep, *fields)])


#: Names of the columns of :func:`row_key`.
KEY = ["none", "id", "body"]


def row_key(docs: DataFrame, id_col: str, text: str) -> list:
    """Never-null columns that name a row by content, in the order null id last, id, hash of the text.

    Whole-number ids are compared as longs, all others as strings.  Unlike a row
    number the columns are the same each time a table is read.  Rows of equal id
    and text share them.
    """
    own = F.col(f"`{id_col}`")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kind, missing = ("long", F.lit(0)) if isinstance(docs.schema[id_col].dataType, T.IntegralType) else ("string", F.lit(""))
    return [own.isNull().alias("none"), F.coalesce(own.cast(kind), missing.cast(kind)).alias("id"), F.xxhash64(body).alias("body")]


def shared_dir(spark) -> str:
    """The folder that all executors and the driver share.

    The session's ``spark.checkpoint.dir``; only where a single-machine session
    (tests) has none, a folder of the machine is set.
    """
    import tempfile

    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir", None)
    if folder:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(folder)
        return folder
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="linkrisk-"))
        have = sc._jsc.sc().getCheckpointDir()
    return have.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder (reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder (written with the ``options``), and its path."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark) -> None:
    """Lets Spark's cleaner drop shuffle files of finished, unreachable plans.

    Python's references go first, then the JVM's; the cleaner works on what the
    second round finds unreachable.
    """
    import gc
    import time

    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


#: A key that more than one in so many rows have is hot: there are fewer of them than this, whatever the data.
HOT = 1024


def spread_join(rows: DataFrame, table: DataFrame, key: Sequence[str], n: str, spread: Sequence[str]) -> DataFrame:
    """``rows`` with ``found``: the other columns of ``table``'s row of the same ``key``, null where there is none.

    ``key`` is unique in ``table`` and begins with a long; ``n`` counts the rows
    that have it.  Keys that hold more than 1/HOT of all that ``n`` counts are
    fewer than HOT, so these are broadcast, and rows that have one are dealt out
    by their ``spread`` columns.  All other keys meet in a shuffled join.
    ``table`` is read several times, so it should be a stored one.
    """
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.col(n) * HOT > total
    found = F.struct(*[F.col(c) for c in table.columns if c not in key])
    few = table.where(hot).select(*key, found.alias("few"))
    most = table.where(~hot).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], F.lit(True).alias("free"), found.alias("most"))
    free = F.col("few").isNull()
    own = [F.when(free, F.col(key[0])).otherwise(F.xxhash64(*spread)), *[F.col(c) for c in key[1:]]]
    dealt = rows.join(F.broadcast(few), list(key), "left").select(*rows.columns, "few", *[c.alias(f"k{i}") for i, c in enumerate(own)], free.alias("free"))
    return dealt.join(most, [*[f"k{i}" for i in range(len(key))], "free"], "left").select(*rows.columns, F.coalesce("few", "most").alias("found"))


def forget(spark, path: str) -> None:
    """Deletes a table that :func:`stored` made."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each row's list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
