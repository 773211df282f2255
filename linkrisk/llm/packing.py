"""Packing of documents into training sequences of bounded length: harmonic classes.

A class is a reciprocal of the capacity: its pieces take a k-th of a sequence,
and k of them fill one.  A document is cut into whole sequences and a rest; the
rest goes, piece by piece, to the classes that it fills.  Every task fills the
sequences of each class with its own documents, without a word to the others.
What is left of a task (less than k pieces of each class) is numbered through
by prefix sums of the tasks' counts and filled the same way; what is then left
of all (less than k pieces of each class, whatever the corpus) is laid end to
end and cut into powers of two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import pieces, stored, trim
from .token_store import TEXT, encoder_of, tokenizer_path

#: Tokens of a sequence, and how many of them may stay empty so that a piece need not be cut.
CAPACITY, SPARE = 1024, 16
#: Sequence numbers: those of a task begin at its number times 2**TASK; later ones from 2**62, by class.
TASK, CLASS = 40, 48
#: Kind of a row that is a filled sequence; all others are a piece's class.
FILLED = -1


class Classes:
    """Sizes of pieces that fill a ``capacity`` by their number, largest first."""

    def __init__(self, capacity: int = CAPACITY, spare: int = SPARE):
        self.capacity = capacity
        self.size = np.unique(capacity // np.arange(1, capacity + 1))[::-1]
        self.count = capacity // self.size
        rest = np.arange(capacity + 1)
        fits = len(self.size) - np.searchsorted(self.size[::-1], rest, "left") - 1  # the smallest size that holds the rest
        fits[0] = 0
        whole = self.count[fits] * (self.size[fits] - rest) <= spare
        part = np.minimum(fits + 1, len(self.size) - 1)  # the largest size within the rest
        #: For each length of a rest: the class of its next piece, and the tokens that the piece takes.
        self.kind = np.where(whole, fits, part)
        self.take = np.where(whole, rest, self.size[part])

    def cut(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first token in it, tokens, class) of the pieces of documents with so many tokens."""
        full = counts // self.capacity
        row = np.repeat(np.arange(len(counts)), full)
        made = [(row, (np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)) * self.capacity, np.full(len(row), self.capacity), np.zeros(len(row), np.int64))]
        at, left = full * self.capacity, counts % self.capacity
        row = np.flatnonzero(left)
        while len(row):
            take = self.take[left[row]]
            made.append((row, at[row], take, self.kind[left[row]]))
            at[row] += take
            left[row] -= take
            row = row[left[row] > 0]
        return tuple(np.concatenate(x) for x in zip(*made))  # type: ignore[return-value]


def _type(id_type: T.DataType) -> T.StructType:
    """part, kind, nth, ids (little-endian unsigned 32-bit), and for each piece in it: document, first token, tokens, the document's tokens, place."""
    return T.StructType(
        [
            T.StructField("part", T.LongType()),
            T.StructField("kind", T.IntegerType()),
            T.StructField("nth", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("docs", T.ArrayType(id_type)),
            *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("starts", "lengths", "totals", "offsets")],
        ]
    )


class Pieces:
    """Pieces of documents: their ids one after another, and where each comes from."""

    def __init__(self, ids: np.ndarray, docs: pa.Array, start: np.ndarray, length: np.ndarray, total: np.ndarray, kind: np.ndarray):
        self.ids, self.docs, self.start, self.length, self.total, self.kind = ids, docs, start, length, total, kind

    def taken(self, at: np.ndarray) -> Pieces:
        """The pieces with these numbers, in their order."""
        begin, n = (np.cumsum(self.length) - self.length)[at], self.length[at]
        place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return Pieces(self.ids[place], self.docs.take(pa.array(at)), self.start[at], n, self.total[at], self.kind[at])

    def after(self, other: Pieces) -> Pieces:
        """Those of ``other`` and these."""
        return Pieces(np.concatenate([other.ids, self.ids]), pa.concat_arrays([other.docs, self.docs]), *[np.concatenate([getattr(other, n), getattr(self, n)]) for n in ("start", "length", "total", "kind")])

    def rows(self, members: np.ndarray, part: int, kind: np.ndarray, nth: np.ndarray) -> pa.RecordBatch:
        """A row for each run of so many pieces."""
        edges = np.concatenate([[0], np.cumsum(members)])
        ends = np.concatenate([[0], np.cumsum(self.length)])
        tokens = ends[edges]
        offset = ends[:-1] - np.repeat(tokens[:-1], members)
        bounds = pa.array(edges.astype(np.int32))
        blob = pa.BinaryArray.from_buffers(pa.binary(), len(members), [None, pa.py_buffer((tokens * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.ids, "<u4"))])
        columns = [pa.array(np.full(len(members), part)), pa.array(kind.astype(np.int32)), pa.array(nth), blob, pa.ListArray.from_arrays(bounds, self.docs)]
        columns += [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int64))) for x in (self.start, self.length, self.total, offset)]
        return pa.RecordBatch.from_arrays(columns, names=["part", "kind", "nth", "ids", "docs", "starts", "lengths", "totals", "offsets"])


class Filler:
    """One task's sequences; pieces wait until as many of their class are there as fill one."""

    def __init__(self, classes: Classes, part: int, id_type: pa.DataType):
        none = np.empty(0, np.int64)
        self.classes, self.part, self.made = classes, part, 0
        self.waiting = Pieces(np.empty(0, np.uint32), pa.array([], id_type), none, none, none, none)

    def add(self, ids: np.ndarray, docs: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        """Takes whole documents and gives the sequences that are full now."""
        row, start, length, kind = self.classes.cut(counts)
        first = (np.cumsum(counts) - counts)[row] + start
        place = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        all_ = Pieces(ids[place], docs.take(pa.array(row)), start, length, counts[row], kind).after(self.waiting)
        order = np.argsort(all_.kind, kind="stable")
        n = np.bincount(all_.kind, minlength=len(self.classes.size))
        bins = n // self.classes.count
        nth = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        full = nth < np.repeat(bins * self.classes.count, n)
        self.waiting = all_.taken(order[~full])
        members = np.repeat(self.classes.count, bins)
        made = all_.taken(order[full]).rows(members, self.part, np.full(len(members), FILLED), self.made + np.arange(len(members)))
        self.made += len(members)
        return made

    def rest(self) -> pa.RecordBatch:
        """The pieces that wait, a row each, numbered within their class."""
        kind = self.waiting.kind
        n = np.bincount(kind, minlength=len(self.classes.size))
        return self.waiting.rows(np.ones(len(kind), np.int64), self.part, kind, np.arange(len(kind)) - np.repeat(np.cumsum(n) - n, n))


def _powers(tokens: int, capacity: int) -> np.ndarray:
    """Lengths of sequences that hold so many tokens: full ones, then powers of two."""
    rest = tokens % capacity
    return np.array([capacity] * (tokens // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def _laid_out(waiting: Pieces, capacity: int) -> pa.RecordBatch:
    """All pieces end to end, cut where a sequence ends."""
    lengths = _powers(len(waiting.ids), capacity)
    ends = np.cumsum(waiting.length)
    cuts = np.unique(np.concatenate([ends, np.cumsum(lengths)]))  # where a piece or a sequence ends
    of = np.searchsorted(ends, cuts, "left")
    size = np.diff(cuts, prepend=0)
    start = waiting.start[of] + (cuts - size) - (ends - waiting.length)[of]
    cut = Pieces(waiting.ids, waiting.docs.take(pa.array(of)), start, size, waiting.total[of], waiting.kind[of])
    members = np.diff(np.searchsorted(cuts, np.cumsum(lengths), "right"), prepend=0)
    return cut.rows(members, 0, np.full(len(members), FILLED), np.arange(len(members)))


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, spare: int = SPARE, tokenizer: str | None = None, end_id: int = 0, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Sequences of at most ``capacity`` tokens that hold every token of every document once.

    A document is its text's ids (null: an empty text) and ``end_id``.  Sequences
    with fewer tokens than ``capacity`` are to be padded, unless their length is
    a power of two; a filled one lacks ``spare`` tokens at most for pieces that
    were not cut, and what capacity // size leaves over.  Columns: sequence_id,
    n_tokens, ids (binary, little-endian unsigned 32-bit), and one entry for each
    piece in docs, starts (its document's tokens before it), lengths, totals (its
    document's tokens) and offsets.  Each row is a document of its own: repeated
    and null ids are kept as they are; an empty table gives no sequences; other
    columns are left out.  A text is one step of the encoder, however long.
    """
    path = tokenizer or tokenizer_path()
    classes = Classes(capacity, spare)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = _type(rows.schema["id"].dataType)

    def fill(batches):
        from pyspark import TaskContext

        encoder, filler = encoder_of(path), None
        for batch in batches:
            filler = filler or Filler(classes, TaskContext.get().partitionId(), batch.column(0).type)
            for piece in pieces(batch, "text", TEXT):
                ids, counts = encoder.encode(piece.column(1))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                yield filler.add(ids, piece.column(0), counts + 1)
        if filler:
            yield filler.rest()
        trim()

    def lay_out(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            flat = {n: table.column(n).combine_chunks().flatten() for n in ("docs", "starts", "lengths", "totals")}
            ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u4")
            numbers = [flat[n].to_numpy() for n in ("starts", "lengths", "totals")]
            yield _laid_out(Pieces(ids, flat["docs"], *numbers, np.zeros(len(numbers[0]), np.int64)), capacity)

    first, _ = stored(rows.mapInArrow(fill, schema), "packed")
    sequence = ["ids", "docs", "starts", "lengths", "totals", "offsets"]
    done = first.where(F.col("kind") == FILLED).select(((F.col("part") * F.lit(1 << TASK)) + F.col("nth")).alias("sequence_id"), *sequence)

    # one row for each task and class: how many pieces of the class earlier tasks have left
    waiting = first.where(F.col("kind") != FILLED)
    by_class = Window.partitionBy("kind")
    left = waiting.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"))
    left = left.select("kind", "part", (F.sum("n").over(by_class.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(by_class).alias("all"))
    members = F.element_at(F.array(*[F.lit(int(c)) for c in classes.count]), F.col("kind") + 1)
    placed = waiting.join(left, ["kind", "part"]).withColumn("place", F.col("before") + F.col("nth")).withColumn("bin", F.floor(F.col("place") / members)).withColumn("full", F.col("bin") < F.floor(F.col("all") / members))
    fields = F.array_sort(F.collect_list(F.struct("place", *[F.col(c) for c in ("ids", "docs", "starts", "lengths", "totals")])))
    met = placed.where("full").groupBy("kind", "bin").agg(fields.alias("p"))
    joined = [F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")]
    joined += [F.flatten(F.col(f"p.{c}")).alias(c) for c in ("docs", "starts", "lengths", "totals")]
    lengths = F.transform("p", lambda x: F.element_at(x["lengths"], 1))
    joined.append(F.transform("p", lambda x, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("long"), lambda a, n: a + n)).alias("offsets"))
    later = F.lit(1 << 62) + F.col("kind").cast("long") * F.lit(1 << CLASS)
    met = met.select((later + F.col("bin")).alias("sequence_id"), *joined)

    # fewer pieces of each class than fill a sequence: their number does not depend on the corpus
    last = placed.where("not full").select(*schema.names, "place").repartition(1).sortWithinPartitions("kind", "place").select(*schema.names)
    last = last.mapInArrow(lay_out, schema).select((F.lit((1 << 62) + (len(classes.size) << CLASS)) + F.col("nth")).alias("sequence_id"), *sequence)
    return done.unionByName(met).unionByName(last).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *sequence)


def packed_pieces(sequences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each piece of :func:`pack_documents`: its document, place, length and the CRC-32 of its ids, read from the sequences."""
    each = sequences.select("sequence_id", "ids", F.explode(F.arrays_zip("docs", "starts", "lengths", "totals", "offsets")).alias("p"))
    body = F.substring(F.col("ids"), (F.col("p.offsets") * 4 + 1).cast("int"), (F.col("p.lengths") * 4).cast("int"))
    return each.select(F.col("p.docs").alias(id_col), F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), F.crc32(body).alias("ids_crc32"), F.col("p.totals").alias("doc_tokens"), "sequence_id", F.col("p.offsets").alias("offset"))
