"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the same bytes.  Places where a token of each ends part a
text into groups; an A token and a B token that share bytes are linked.  How
often the corpus links each pair of ids is counted in dense matrices: ids of B
are dealt out in stripes, a task adds what all shards have seen into the block
of a stripe, and the maximum of a row says which A ids go best with that B id.

Text is cut where both tokenizers part it whatever stands around: before a
blank that follows a character that surely is no white space.  A task aligns
each distinct piece once.  A *shard* is what one task made of up to KNOWN
pieces: for its documents, the numbers of their pieces; for its pieces, the
numbers of their pairs; for its pairs, what they count.  Counts go to the
stripes, and come back for the pairs of each shard; documents are scored where
those of their shard meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import buffers, pieces, stored, trim
from .token_store import Encoder

#: Distinct pieces of text from which on a worker closes its shard and forgets them; bytes of text in one step.
KNOWN, STEP = 500_000, 8 << 20
#: Bytes of one stripe's dense block of counts.
BLOCK_BYTES = 32 << 20
#: Kinds of rows, in the order in which scoring needs them: a shard's pieces, its pairs, its documents.
PIECES, PAIRS, DOCUMENT = 0, 1, 2


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_values() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _large(column: pa.Array) -> np.ndarray:
    """The bytes of a large binary column."""
    _, offs, data = column.buffers()
    if not len(column) or data is None or not data.size:
        return np.empty(0, np.uint8)
    edge = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[edge[0] : edge[-1]]


class Aligner:
    """What a worker knows of pieces of text under both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        value = byte_values()
        raw_a = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.size)]
        raw_a = [bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t in raw_a]
        b_ids = range(self.b.get_piece_size())
        raw_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        self.bytes_a, self.bytes_b = pa.array(raw_a, pa.large_binary()), pa.array(raw_b, pa.large_binary())
        self.length_a, self.length_b = (np.array([len(x) for x in raw], np.int64) for raw in (raw_a, raw_b))
        #: Keys of pairs are b * size_a + a.
        self.size_a, self.size_b = len(raw_a), len(raw_b)
        self.kind = "<u4" if self.size_a * self.size_b < 1 << 32 else "<u8"
        # ids as text: A inside a group and at its end, then B
        self.written = pa.array([f"{i}{end}".encode() for size, ends in ((self.size_a, ",|"), (self.size_b, ",;")) for end in ends for i in range(size)], pa.large_binary())
        one, two = self.b.encode("x"), self.b.encode("x ")
        self.blank = two[len(one) :]  # a single blank alone would count as the added one
        self.forget()

    def forget(self) -> None:
        none = np.empty(0, np.int64)
        self.known, self.text = pa.array([], pa.binary()), pa.array([], pa.large_binary())
        self.n_a, self.n_b, self.groups, self.links = none, none, none, none
        self.good, self.keys, self.edges = np.empty(0, bool), none, np.zeros(1, np.int64)

    def places(self, distinct: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces among those known; new ones are aligned."""
        at = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = distinct.take(pa.array(new))
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self._align(fresh)
        return at

    def _align(self, fresh: pa.Array) -> None:
        data, offsets = buffers(fresh)
        size = np.diff(offsets)
        ids_a, n_a = self.a.encode(fresh)
        made = [x or self.blank for x in self.b.encode([x[1:].decode() for x in fresh.to_pylist()], num_threads=1)]
        n_b = np.array([len(x) for x in made], np.int64)
        ids_b = np.fromiter((i for x in made for i in x), np.int64, int(n_b.sum()))
        ids_a = ids_a.astype(np.int64)
        good = self._same(data, size, self.bytes_a, self.length_a, ids_a, n_a) & self._same(data, size, self.bytes_b, self.length_b, ids_b, n_b)
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        n_a, n_b, end = np.where(good, n_a, 0), np.where(good, n_b, 0), np.cumsum(np.where(good, size, 0))
        end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        every = np.union1d(end_a, end_b)
        # each stretch between two ends is what one pair shares
        keys = ids_b[np.searchsorted(end_b, every)] * self.size_a + ids_a[np.searchsorted(end_a, every)]
        links = self._per_piece(end, every)
        self.n_a, self.n_b, self.links = np.append(self.n_a, n_a), np.append(self.n_b, n_b), np.append(self.links, links)
        self.groups, self.good = np.append(self.groups, self._per_piece(end, shared)), np.append(self.good, good)
        self.keys, self.edges = np.append(self.keys, keys), np.append(self.edges, self.edges[-1] + np.cumsum(links))
        self.text = pa.concat_arrays([self.text, self._written(ids_a, ids_b, end_a, end_b, shared, n_a + n_b)])

    @staticmethod
    def _per_piece(end: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(end, at), minlength=len(end))

    @staticmethod
    def _same(data, size, table, length, ids, n) -> np.ndarray:
        """Whether the bytes of each piece's tokens are the piece."""
        total = np.concatenate([[0], np.cumsum(length[ids])])
        edges = np.concatenate([[0], np.cumsum(n)])
        out = total[edges[1:]] - total[edges[:-1]] == size
        keep = np.repeat(out, n)
        joined = _large(table.take(pa.array(ids[keep])))
        differs = np.concatenate([[0], np.cumsum(joined != data[np.repeat(out, size)])])
        ends = np.cumsum(np.where(out, size, 0))
        return out & (differs[ends] == differs[ends - np.where(out, size, 0)])

    def _written(self, ids_a, ids_b, end_a, end_b, shared, n) -> pa.Array:
        """Each piece's groups: A ids by commas, a bar, B ids by commas, a semicolon."""
        of_a, of_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        before_b = np.searchsorted(end_b, np.concatenate([[0], shared]), "right")  # B tokens of earlier groups
        upto_a = np.searchsorted(end_a, shared, "right")
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + before_b[of_a]] = ids_a + self.size_a * (shared[of_a] == end_a)
        codes[np.arange(len(ids_b)) + upto_a[of_b]] = ids_b + 2 * self.size_a + self.size_b * (shared[of_b] == end_b)
        tokens = self.written.take(pa.array(codes))
        edges = np.frombuffer(tokens.buffers()[1], np.int64)[: len(codes) + 1] if len(codes) else np.zeros(1, np.int64)
        bounds = edges[np.concatenate([[0], np.cumsum(n)])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds), tokens.buffers()[2] or pa.py_buffer(b"")])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner; what it knows serves all tasks that the worker runs."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def stripes(size_a: int, size_b: int) -> int:
    """How many stripes of B ids there are, so that the block of each keeps to its bytes."""
    return -(-size_b // max(1, BLOCK_BYTES // (8 * size_a)))


FIELDS = [("shard", pa.int64()), ("kind", pa.int32()), ("stripe", pa.int32()), ("at", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("pairs", pa.binary()), ("links", pa.binary()), ("words", pa.binary()), ("width", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha256", pa.string()), ("groups", pa.string())]


def _batch(id_type: pa.DataType, rows: int, **columns) -> pa.RecordBatch:
    """A batch of all fields; those not given are null."""
    made = [columns.get("id", pa.nulls(rows, id_type))]
    for name, kind in FIELDS:
        x = columns.get(name)
        made.append(pa.nulls(rows, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind))
    return pa.RecordBatch.from_arrays(made, names=["id", *[n for n, _ in FIELDS]])


class Shard:
    """Pieces that a task's documents have had so far, and how often."""

    def __init__(self, aligner: Aligner, number: int):
        self.aligner, self.number = aligner, number
        self.slot = np.empty(0, np.int64)  # of each known piece: its number here, -1 if it has none
        self.members, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, column: pa.Array, ids: pa.Array, written: bool) -> pa.RecordBatch:
        """A row for each document."""
        aligner, rows = self.aligner, len(column)
        text = pc.binary_join_element_wise("", pc.fill_null(column, ""), " ")  # a blank in front of each text
        data, offsets = buffers(text)
        start = self._edges(data, offsets)
        bounds = pa.py_buffer(np.append(start, len(data)).astype(np.int32))
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        place = aligner.places(coded.dictionary)[coded.indices.to_numpy()]
        first = np.searchsorted(start, offsets)
        bad = np.concatenate([[0], np.cumsum(~aligner.good[place])])
        real = (np.diff(bad[first]) == 0) & (np.diff(offsets) > 1)  # texts that both tokenizers give back, empty ones aside
        keep = np.repeat(real, np.diff(first))
        place = place[keep]
        first = np.concatenate([[0], np.cumsum(np.where(real, np.diff(first), 0))])
        total = {n: np.diff(np.concatenate([[0], np.cumsum(getattr(aligner, n)[place])])[first]) for n in ("n_a", "n_b", "groups", "links")}
        texts = aligner.text.take(pa.array(place))
        blob = memoryview(np.ascontiguousarray(_large(texts)))
        edge = np.frombuffer(texts.buffers()[1], np.int64)[: len(place) + 1] if len(place) else np.zeros(1, np.int64)
        spans = list(zip(edge[first[:-1]].tolist(), edge[first[1:]].tolist()))  # a semicolon ends each
        sha = [hashlib.sha256(blob[a : b - 1]).hexdigest() if b > a else "" for a, b in spans]
        groups = [bytes(blob[a : max(a, b - 1)]).decode() for a, b in spans] if written else None
        own = self._slots(place)
        width = 2 if len(self.members) <= 1 << 16 else 4
        packed = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(own.astype(f"<u{width}"))])
        return _batch(ids.type, rows, id=ids, shard=np.full(rows, self.number), kind=np.full(rows, DOCUMENT), words=packed, width=np.full(rows, width), n_a=total["n_a"], n_b=total["n_b"], n_groups=total["groups"], n_links=total["links"], sha256=sha, groups=groups)

    @staticmethod
    def _edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin: at texts, and at blanks after what surely is no white space."""
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1]] = True
        at = np.flatnonzero(data == 32)
        at = at[~begins[at]]
        begins[at[Encoder._sure(data, at)]] = True
        return np.flatnonzero(begins)

    def _slots(self, place: np.ndarray) -> np.ndarray:
        """The shard's numbers of known pieces, each of which stands in a document once more."""
        self.slot = np.append(self.slot, np.full(len(self.aligner.known) - len(self.slot), -1))
        new = np.unique(place[self.slot[place] < 0])
        self.slot[new] = len(self.members) + np.arange(len(new))
        self.members = np.append(self.members, new)
        own = self.slot[place]
        self.times = np.append(self.times, np.zeros(len(new), np.int64)) + np.bincount(own, minlength=len(self.members))
        return own

    def close(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A row with the pieces' pairs, and one with the pairs' counts for each stripe."""
        aligner = self.aligner
        n = aligner.links[self.members]
        if not n.sum():
            return
        flat = np.repeat(aligner.edges[self.members] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        keys, number = aligner.keys[flat], stripes(aligner.size_a, aligner.size_b)
        every = aligner.size_a * aligner.size_b
        codes, pair = np.unique((keys // aligner.size_a) % number * every + keys, return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, pair, np.repeat(self.times, n))
        yield _batch(id_type, 1, shard=[self.number], kind=[PIECES], at=[len(codes)], pairs=[pair.astype("<u4").tobytes()], links=[n.astype("<u4").tobytes()])
        stripe, keys = codes // every, (codes % every).astype(aligner.kind)
        edge = np.flatnonzero(np.diff(stripe, prepend=-1))
        spans = list(zip(edge.tolist(), [*edge[1:].tolist(), len(codes)]))
        k = len(spans)
        yield _batch(id_type, k, shard=[self.number] * k, kind=[PAIRS] * k, stripe=stripe[edge], at=edge, keys=[keys[a:b].tobytes() for a, b in spans], counts=[counts[a:b].tobytes() for a, b in spans])


class Block:
    """A stripe's dense counts: a row for each of its B ids, a column for each A id."""

    def __init__(self, size_a: int, size_b: int):
        self.size_a, self.number = size_a, stripes(size_a, size_b)
        self.count = np.zeros((-(-size_b // self.number), size_a), np.int64)

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, a = np.divmod(keys.astype(np.int64), self.size_a)
        return b // self.number, a

    def clear(self) -> None:
        self.count[:] = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        np.add.at(self.count, self.at(keys), counts)


def align_tokenizers(docs: DataFrame, *, a_path: str | None = None, b_path: str | None = None, text: str = "text", id_col: str = "doc_id", groups: bool = False, known: int = KNOWN, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): how both tokenizers cut each text, and which ids go together.

    A is a byte-level BPE of the tokenizers library and reads a blank and the
    text; B is a sentencepiece model that adds the blank itself.  Special tokens'
    strings are plain text.  documents: id, n_a, n_b, n_groups, n_links, n_best
    (links whose pair counts as much as any of its B id), count_sum (of the
    pairs of all links), groups_sha256, and groups if asked for.  pairs: b, a,
    n (links in the corpus), best.  Null and empty texts, and those that the
    tokens of one side do not give back, have no tokens: zeros and an empty
    string.  Repeated rows are documents of their own; other columns are left
    out; an empty table gives no rows.  A text is one step, however long.
    ``known`` and ``step`` bound what a task holds and change no result.
    """
    paths_ = a_path or paths()[0], b_path or paths()[1]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    spark = docs.sparkSession
    aligner = aligner_of(*paths_)
    size_a, size_b, kind = aligner.size_a, aligner.size_b, aligner.kind
    id_field = rows.schema["id"]
    schema = T.StructType([id_field, *[T.StructField(n, {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.binary(): T.BinaryType(), pa.string(): T.StringType()}[k]) for n, k in FIELDS]])

    def align(batches):
        from pyspark import TaskContext

        aligner, shard, number = aligner_of(*paths_), None, 0
        for batch in batches:
            for piece in pieces(batch, "text", step):
                if len(aligner.known) > known:
                    if shard:
                        yield from shard.close(piece.column(0).type)
                    aligner.forget()
                    shard = None
                if not shard:
                    shard, number = Shard(aligner, (TaskContext.get().partitionId() << 24) + number), number + 1
                yield shard.add(piece.column(1), piece.column(0), groups)
        if shard:
            yield from shard.close(piece.column(0).type)
        trim()

    made, _ = stored(rows.mapInArrow(align, schema), "aligned")

    def count(batches):
        """All counts of a stripe, a row for each."""
        block, now = Block(size_a, size_b), None

        def close():
            row, a = np.nonzero(block.count)
            n = block.count[row, a]
            best = n == block.count.max(axis=1)[row]
            key = (row * block.number + now) * size_a + a
            block.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *[pa.array([x], pa.binary()) for x in (key.astype(kind).tobytes(), n.tobytes(), best.tobytes())]], names=["stripe", "keys", "counts", "best"])

        for batch in batches:
            for stripe, keys, counts in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if now not in (None, stripe):
                    yield close()
                now = stripe
                block.add(np.frombuffer(keys, kind), np.frombuffer(counts, np.int64))
        if now is not None:
            yield close()
        trim()

    asked = made.where(F.col("kind") == PAIRS).select("stripe", "keys", "counts", "shard", "at")
    counted, _ = stored(asked.select("stripe", "keys", "counts").repartition("stripe").sortWithinPartitions("stripe").mapInArrow(count, "stripe int, keys binary, counts binary, best binary"), "pairs")

    def answer(batches):
        """For each row of a shard's pairs: what they count in the corpus, and whether no pair of their B id counts more."""
        block = Block(size_a, size_b)
        best = np.zeros(block.count.shape, bool)
        for batch in batches:
            shards, at, counts, flags = [], [], [], []
            for shard, place, keys, n, flag in zip(*[batch.column(k).to_pylist() for k in range(1, 6)]):
                cell = block.at(np.frombuffer(keys, kind))
                if shard is None:  # the stripe's counts come first; no shard asks for pairs that they don't hold
                    block.count[cell], best[cell] = np.frombuffer(n, np.int64), np.frombuffer(flag, bool)
                else:
                    shards.append(shard), at.append(place), counts.append(block.count[cell].tobytes()), flags.append(best[cell].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(at, pa.int64()), pa.array(counts, pa.binary()), pa.array(flags, pa.binary())], names=["shard", "at", "counts", "best"])
        trim()

    nothing = lambda kind: F.lit(None).cast(kind)
    wanted = asked.select("stripe", "shard", "at", "keys", nothing("binary").alias("counts"), nothing("binary").alias("best"))
    have = counted.select("stripe", nothing("long").alias("shard"), nothing("long").alias("at"), "keys", "counts", "best")
    answers = have.unionByName(wanted).repartition("stripe").sortWithinPartitions("stripe", F.col("shard").asc_nulls_first()).mapInArrow(answer, "shard long, at long, counts binary, best binary")

    names = ["n_a", "n_b", "n_groups", "n_links", "sha256", *(["groups"] if groups else [])]
    out_type = T.StructType([id_field, *[schema[n] for n in names], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def score(batches):
        """Documents by what the pairs of their pieces count; a shard's pieces and answers come before its documents."""
        pairs = links = value = flag = points = None
        for batch in batches:
            sums, hits, at = [], [], []
            columns = [batch.column(k) for k in range(batch.num_columns)]
            kinds = columns[1].to_pylist()
            for i, what in enumerate(kinds):
                if what == PIECES:
                    pairs, links = (np.frombuffer(columns[k][i].as_py(), "<u4").astype(np.int64) for k in (5, 6))
                    n = columns[2][i].as_py()
                    value, flag, points = np.zeros(n, np.int64), np.zeros(n, np.int64), None
                elif what == PAIRS:
                    a, counts = columns[2][i].as_py(), np.frombuffer(columns[3][i].as_py(), np.int64)
                    value[a : a + len(counts)], flag[a : a + len(counts)] = counts, np.frombuffer(columns[4][i].as_py(), bool)
                else:
                    word = columns[7][i].as_buffer()
                    if word is not None and word.size:
                        if points is None:
                            edge = np.concatenate([[0], np.cumsum(links)])
                            points = [np.diff(np.concatenate([[0], np.cumsum(x[pairs])])[edge]) for x in (value, flag)]
                        own = np.frombuffer(word, f"<u{columns[8][i].as_py()}")
                        sums.append(int(points[0][own].sum())), hits.append(int(points[1][own].sum()))
                    else:
                        sums.append(0), hits.append(0)
                    at.append(i)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([columns[9].take(take), *[c.take(take) for c in columns[10:]], pa.array(hits, pa.int64()), pa.array(sums, pa.int64())], names=out_type.names)
        trim()

    parts = made.where(F.col("kind") != PAIRS).select("shard", "kind", "at", nothing("binary").alias("counts"), nothing("binary").alias("best"), "pairs", "links", "words", "width", "id", *names)
    back = answers.select("shard", F.lit(PAIRS).alias("kind"), "at", "counts", "best")
    together = parts.unionByName(back, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "kind")
    scored = together.mapInArrow(score, out_type)
    documents = scored.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha256").alias("groups_sha256"), *(["groups"] if groups else []))

    def unpacked(batches):
        for batch in batches:
            for keys, n, best in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                b, a = np.divmod(np.frombuffer(keys, kind).astype(np.int64), size_a)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(a), pa.array(np.frombuffer(n, np.int64)), pa.array(np.frombuffer(best, bool))], names=["b", "a", "n", "best"])

    return documents, counted.select("keys", "counts", "best").mapInArrow(unpacked, "b long, a long, n long, best boolean")
