"""Token ids in binary: a static range asymmetric numeral system (rANS).

Format.  A table of *segments*, in ascending document order.  A segment holds
whole documents; its ids are cut into blocks of BLOCK tokens, and each block is
coded by LANES interleaved states with the frequency table that all blocks
share (``<path>/frequencies``).  A block begins at its checkpoint (byte offset
in the payload), carries the final states of its lanes and a CRC-32 of its ids,
and can be decoded without any other block.  Tables are written and read by
Spark alone, so any store that Spark reaches will do.

Columns of ``<path>/segments``: part and row (the order of the segments), doc_ids,
lengths, n_tokens, checkpoints, checksums, payload.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import U64, buffers, forget, lists, pieces, release, shared_dir, stored, trim

#: Tokens of a block, states of a block, tokens at which a segment is closed.
BLOCK, LANES, SEGMENT = 8192, 32, 1 << 19
#: Bits of the frequency scale; lowest state; bits that a state sends out at a time.
SCALE, LOWEST, WORD = 20, 1 << 31, 32
#: Distinct pieces of text from which on a worker forgets those it knows; pieces that are encoded at a time.
KNOWN, TOGETHER = 500_000, 256
#: Bytes of text whose distinct pieces are found together.
TEXT = 8 << 20
_ALL = np.arange(256)
_IS_LETTER = ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122))
WHITE, LETTER, PUNCTUATION = 1, 2, 3
#: ASCII white space, letters and punctuation; all else is 0.
KINDS = np.select([(_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)), _IS_LETTER, (_ALL > 32) & (_ALL < 127) & ~((_ALL >= 48) & (_ALL <= 57))], [WHITE, LETTER, PUNCTUATION], 0).astype(np.uint8)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to ids by the tokenizers library, each distinct piece of a batch once.

    A piece begins at white space that follows another character, and at
    punctuation that follows a letter.  The tokenizer's pattern always parts text
    there and looks no further back, so pieces can be encoded alone.  Arrow finds
    the distinct pieces of a batch by their bytes; those that earlier batches had
    are known, the others are encoded many at a time, parted by line feeds.
    ``plain``: the strings of special tokens are text like any other.
    """

    def __init__(self, path: str, plain: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        step = spec.get("pre_tokenizer") or {}
        self.specials = [] if plain else [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.size = self.tokenizer.get_vocab_size()
        mark = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # pieces may be cut only where the tokenizer is known to part text itself
        self.by_piece = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space") and spec.get("normalizer") is None and spec.get("post_processor") is None and len(mark) == 1
        self.mark = mark[0] if mark else -1
        if self.by_piece and hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # no piece is encoded twice
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.edges = pa.array([], pa.binary()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        data, offsets = buffers(column)
        blob = memoryview(np.ascontiguousarray(data))
        if not self.by_piece or any(x in bytes(blob) for x in self.specials):
            made = self._whole([bytes(blob[a:b]).decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            return np.concatenate([np.empty(0, np.uint32), *made]), np.array([len(x) for x in made], np.int64)
        start = self._edges(data, offsets)
        bounds = pa.py_buffer(np.append(start, len(data)).astype(np.int32))
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, bounds, pa.py_buffer(blob)]).dictionary_encode()
        begin, size = self._places(coded.dictionary)
        # ids of each piece in the order of the text
        which = coded.indices.to_numpy()
        n = size[which]
        total = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((begin[which] - total[:-1]).astype(np.int32), n)
        place += np.arange(total[-1], dtype=np.int32)
        return self.flat[place], np.diff(total[np.searchsorted(start, offsets)])

    @staticmethod
    def _sure(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the characters that end before these places surely are no white space."""
        b1, b2, b3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        two = (b2 >= 0xC3) & (b2 <= 0xDF)
        three = (b2 >= 0x80) & (b2 < 0xC0) & ((b3 == 0xE0) | ((b3 >= 0xE3) & (b3 <= 0xEF))) & ~((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))
        four = (b2 >= 0x80) & (b2 < 0xC0) & (b3 >= 0x80) & (b3 < 0xC0)
        return ((b1 > 0x20) & (b1 < 0x7F)) | ((b1 >= 0x80) & (two | three | four))

    @classmethod
    def _edges(cls, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin: at texts, at ASCII white space after what surely is none, at ASCII punctuation after an ASCII letter."""
        kind = KINDS[data]
        at = np.flatnonzero((kind[1:] == WHITE) & (kind[:-1] != WHITE)) + 1 if len(data) else np.empty(0, np.int64)
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        begins[at[cls._sure(data, at)]] = True
        begins[1:] |= (kind[1:] == PUNCTUATION) & (kind[:-1] == LETTER)
        return np.flatnonzero(begins)

    def _places(self, pieces_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of distinct pieces begin, and how many there are."""
        if len(self.known) > KNOWN:
            self._forget()
        at = pc.index_in(pieces_, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = pieces_.take(pa.array(new))
            at[new] = len(self.known) + np.arange(len(new))
            ids, sizes = self._fresh(fresh)
            self.known = pa.concat_arrays([self.known, fresh])
            self.flat = np.concatenate([self.flat, ids])
            self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(sizes)])
        return self.edges[at], self.edges[at + 1] - self.edges[at]

    def _fresh(self, pieces_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, numbers of ids) of pieces.

        A piece without white space, but for one blank in front, is encoded as
        it is between line feeds; the others are encoded alone.
        """
        data, offsets = buffers(pieces_)
        white = np.concatenate([[0], np.cumsum(KINDS[data] == WHITE)])
        inside = white[offsets[1:]] - white[offsets[:-1]] - (data[offsets[:-1]] == 32)
        plain = (inside == 0) & self._sure(data, offsets[1:])
        raw = pieces_.to_pylist()
        of = np.flatnonzero(plain).tolist()
        texts = [b"\n".join([*[raw[i] for i in of[a : a + TOGETHER]], b""]).decode() for a in range(0, len(of), TOGETHER)]
        found = np.concatenate([np.empty(0, np.uint32), *self._whole(texts)])
        marks = np.flatnonzero(found == self.mark)
        if len(marks) != len(of):
            raise RuntimeError("the tokenizer doesn't part text at line feeds")
        sizes = np.zeros(len(raw), np.int64)
        sizes[plain] = np.diff(marks, prepend=-1) - 1
        odd = np.flatnonzero(~plain)
        alone = self._whole([raw[i].decode() for i in odd.tolist()])
        sizes[odd] = [len(x) for x in alone]
        begin = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.uint32)
        of_plain = np.repeat(plain, sizes)
        flat[of_plain] = found[found != self.mark]
        for b, x in zip(begin[odd].tolist(), alone):
            flat[b : b + len(x)] = x
        return flat, sizes


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder; what it knows serves all tasks that the worker runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to 2**SCALE in all; every symbol that occurs keeps one share at least."""
    total = int(counts.sum())
    room = 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(object) * room // total), 0).astype(np.int64)
    over = int(freq.sum()) - room
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    for s in order:  # symbols of share 1 took more than their due; the commonest give it back
        if over <= 0:
            break
        give = min(over, int(freq[s]) // 2)
        freq[s] -= give
        over -= give
    return freq


class Coder:
    """Codes many blocks at once; one step handles a token of every lane of every block."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U64)
        first = np.zeros(len(freq), np.int64)
        np.cumsum(freq[:-1], out=first[1:])
        self.first = first.astype(U64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, list[int], list[int]]:
        """(payload, checkpoints, checksums) of one segment's ids."""
        blocks = -(-len(ids) // BLOCK)
        if not blocks:
            return b"", [], []
        steps = BLOCK // LANES
        freq, first = np.append(self.freq, U64(1 << SCALE)), np.append(self.first, U64(0))
        grid = np.full(blocks * BLOCK, -1, np.int64)
        grid[: len(ids)] = ids
        grid = grid.reshape(blocks, steps, LANES)
        state = np.full((blocks, LANES), LOWEST, U64)
        sent = np.zeros((steps, blocks, LANES), np.uint32)
        out = np.zeros((steps, blocks, LANES), bool)
        for t in range(steps - 1, -1, -1):
            symbol = grid[:, t]
            f, c = freq[symbol], first[symbol]  # -1 (no token) finds the whole scale, which leaves a state as it is
            full = state >= (f << U64(63 - SCALE))
            full &= symbol >= 0
            sent[t] = state  # the low 32 bits
            out[t] = full
            state = np.where(full, state >> U64(WORD), state)
            quotient = state // f
            state = (quotient << U64(SCALE)) + (state - quotient * f) + c
        payload, checkpoints, checksums, at = [], [], [], 0
        for b in range(blocks):
            checkpoints.append(at)
            body = state[b].astype("<u8").tobytes() + sent[:, b][out[:, b]].astype("<u4").tobytes()
            checksums.append(zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()))
            payload.append(body)
            at += len(body)
        return b"".join(payload), checkpoints, checksums

    def decode(self, payload: bytes, checkpoints, n_tokens: int, checksums=None, blocks: tuple[int, int] | None = None) -> np.ndarray:
        """Ids of the blocks [from, to), by default of all; raises ValueError where a checksum fails."""
        total = len(checkpoints)
        lo, hi = blocks or (0, total)
        count = hi - lo
        if count <= 0:
            return np.empty(0, np.int64)
        edges = np.append(np.asarray(checkpoints, np.int64), len(payload))
        steps = BLOCK // LANES
        words = np.frombuffer(payload, "<u4")
        state = np.stack([np.frombuffer(payload, "<u8", LANES, int(edges[b])) for b in range(lo, hi)]).astype(U64)
        at = edges[lo:hi] // 4 + LANES * 2
        size = np.minimum(BLOCK, n_tokens - np.arange(lo, hi) * BLOCK)
        got = np.zeros((count, steps, LANES), np.int64)
        lane = np.arange(LANES)
        mask = U64((1 << SCALE) - 1)
        for t in range(steps):
            real = t * LANES + lane[None, :] < size[:, None]
            if not real.any():
                break
            slot = state & mask
            symbol = self.symbol[slot.astype(np.int64)]
            got[:, t] = symbol
            moved = self.freq[symbol] * (state >> U64(SCALE)) + slot - self.first[symbol]
            state = np.where(real, moved, state)
            short = real & (state < U64(LOWEST))
            order = np.cumsum(short, axis=1)
            place = np.minimum(at[:, None] + order - 1, len(words) - 1) if len(words) else order
            state = np.where(short, (state << U64(WORD)) | words[place].astype(U64), state)
            at = at + order[:, -1]
        flat = got.reshape(count, BLOCK)
        if checksums is not None:
            for k in range(count):
                if zlib.crc32(flat[k, : size[k]].astype("<u4").tobytes()) != checksums[lo + k]:
                    raise ValueError(f"block {lo + k}: its checksum doesn't match")
        return np.concatenate([flat[k, : size[k]] for k in range(count)])


SEGMENTS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("row", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("checkpoints", T.ArrayType(T.LongType())),
        T.StructField("checksums", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _tokenized(docs: DataFrame, text: str, id_col: str, path: str, size: int, kind: str, end_id: int | None) -> DataFrame:
    """part, row, id and ids (packed as ``kind``), sorted by id within range partitions.

    The last row of a part has no id and no ids, but the part's counts: tokens
    and how often they occur, as packed longs.
    """

    def run(batches):
        encoder = encoder_of(path)
        total = np.zeros(size, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text", TEXT):
                ids, counts = encoder.encode(piece.column(1))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                total += np.bincount(ids, minlength=size)
                blob, edges = ids.astype(kind).tobytes(), np.concatenate([[0], np.cumsum(counts)]) * np.dtype(kind).itemsize
                packed = pa.array([blob[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), packed, pa.nulls(len(packed), pa.binary())], names=["id", "ids", "counts"])
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.stack([used, total[used]]).astype("<i8").tobytes()], pa.binary())], names=["id", "ids", "counts"])
        trim()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text").asc()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text").asc(), "text")
    made = ordered.mapInArrow(run, "id long, ids binary, counts binary")
    return made.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "id", "ids", "counts")


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int | None = 2, text: str = "text", id_col: str = "doc_id") -> None:
    """Writes the ids of all texts to ``path`` in ascending id order.

    Null counts as the empty text; ``end_id`` closes each document.  A null id
    stands before all others; repeated ids stand next to each other.  Texts are
    tokenized once, into a table in the shared folder that is deleted after the
    frequency table is known and the blocks are written.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    size = Encoder(tokenizer).size
    size = max(size, (end_id or 0) + 1)
    kind = "<u2" if size - 1 < 1 << 16 else "<u4"
    tokens, at = stored(_tokenized(docs, text, id_col, tokenizer, size, kind, end_id), "tokens")
    release(spark)

    def unpacked(batches):
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                token, n = np.frombuffer(packed, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], names=["token", "n"])

    counted = tokens.where(F.col("counts").isNotNull()).select("counts").mapInArrow(unpacked, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[counted.column("token").to_numpy()] = counted.column("n").to_numpy()
    freq = frequencies(counts)
    spark.createDataFrame([(SCALE, [int(f) for f in freq])], "scale int, frequencies array<long>").coalesce(1).write.parquet(f"{path}/frequencies")
    sent = spark.sparkContext.broadcast(freq)

    def encode(batches):
        coder, width = Coder(sent.value), np.dtype(kind).itemsize
        types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        held: list[tuple] = []
        tokens_held = 0

        def close():
            flat = np.concatenate([np.frombuffer(x[3], kind) for x in held]).astype(np.int64)
            payload, checkpoints, checksums = coder.encode(flat)
            columns = [held[0][0], held[0][1], [x[2] for x in held], [len(x[3]) // width for x in held], len(flat), checkpoints, checksums, payload]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types)], names=SEGMENTS.names)

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                # a segment holds neighbours only: rows of one part without a gap
                if held and (tokens_held >= SEGMENT or row[0] != held[-1][0] or row[1] != held[-1][1] + 1):
                    yield close()
                    held, tokens_held = [], 0
                held.append(row)
                tokens_held += len(row[3]) // width
        if held:
            yield close()
        trim()

    tokens.where(F.col("counts").isNull()).select("part", "row", "id", "ids").mapInArrow(encode, SEGMENTS).write.parquet(f"{path}/segments")
    forget(spark, at)


def read_tokens(spark, path: str, *, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if asked for) ids of each document, decoded from the files.

    start: ids of all documents before it.  Each block's checksum is verified.
    """
    freq = np.array(spark.read.parquet(f"{path}/frequencies").first()["frequencies"], np.int64)
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    # one row for each part, then one for each segment of a part: how many ids stand before it
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = segments.select("part", "row", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("base"))
    starts = sizes.select("part", "row", before(Window.partitionBy("part").orderBy("row")).alias("inner")).join(parts, "part").select("part", "row", (F.col("base") + F.col("inner")).alias("start"))
    placed = segments.join(starts, ["part", "row"]).select("start", "doc_ids", "lengths", "n_tokens", "checkpoints", "checksums", "payload")
    sent = spark.sparkContext.broadcast(freq)

    def decode(batches):
        coder = Coder(sent.value)
        for batch in batches:
            for k in range(batch.num_rows):
                start, doc_ids, lengths, n, checkpoints, checksums, payload = (batch.column(c)[k].as_py() for c in range(7))
                flat = coder.decode(payload, checkpoints, n, checksums).astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(lists(flat.astype(np.int32), np.asarray(lengths), pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def new_store(spark) -> str:
    """A fresh path in the shared folder."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
