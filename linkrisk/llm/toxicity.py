"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and the beginnings of its words (inflected or run-on
forms share them).  Besides a weight, every term has a short vector, and a pair
of terms adds the product of their vectors: an insult next to a group mention
can count for more, or a quotation mark for less, than both do alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import ALNUM, LOWER, PIECE, U64, Words, extended, lists, span_hashes, trim

#: Hash bins, length of a term's vector.
BITS, FACTORS = 18, 8
#: Beginnings of words that are terms, in bytes.
HEADS = (5, 7)
#: Training looks at no more labelled rows than this (chosen by a hash of their id and text; whole texts).
SAMPLE_ROWS = 16000
#: A term is learned if that many training rows have it, and if its chi-square with the label is that large, over all
#: rows or (raised by the number of such pairs) over the rows of one of the terms that go with the label most.
LEAST_ROWS, LEAST_CHI, PARTNERS = 3, 6.0, 256
#: Training rows that are counted at a time.
CHUNK = 512


def terms(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of the distinct terms of each text, sorted."""
    words = Words(column, ALNUM, LOWER)
    row = words.row_of().astype(U64)
    length = words.end - words.start
    codes = [(row << U64(BITS)) | (words.hashes() >> U64(64 - BITS))]
    for n in HEADS:
        long = length > n
        start = words.start[long]
        h = span_hashes(words.data, start, start + n, seed=1)
        codes.append((row[long] << U64(BITS)) | (h >> U64(64 - BITS)))
    found = np.concatenate(codes)
    found.sort()
    found = found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found
    return (found >> U64(BITS)).astype(np.int64), (found & U64((1 << BITS) - 1)).astype(np.int64)


class Machine:
    """A trained factorization machine: bias, weights and vectors of all bins."""

    def __init__(self, bins: list[np.ndarray], labels: np.ndarray, *, epochs: int = 8, rate: float = 0.1, decay: float = 1e-2, batch: int = 64, seed: int = 11):
        r = np.random.default_rng(seed)
        size = 1 << BITS
        names = np.flatnonzero(self._learned(bins, labels, size))
        self.place = np.full(size, -1, np.int32)
        self.place[names] = np.arange(len(names))
        bins = [x[x >= 0] for x in (self.place[b] for b in bins)]
        rate_of_ones = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
        self.bias = np.log(rate_of_ones / (1 - rate_of_ones))
        self.weight = np.zeros(len(names))
        self.vector = r.normal(0, 0.01, (len(names), FACTORS))
        self.seen = bool(len(labels))
        g_w, g_v, g_b = np.full(len(names), 1e-3), np.full((len(names), FACTORS), 1e-3), 1e-3
        for _ in range(epochs):
            order = r.permutation(len(bins))
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                counts = np.array([len(bins[i]) for i in part])
                at = np.concatenate([bins[i] for i in part])
                row = np.repeat(np.arange(len(part)), counts)
                p, sums = self._scores(at, row, len(part))
                error = p - labels[part]
                self_error = error[row]
                # as in the score, a row's pairs count by the root of its number of terms
                pair_error = self_error / np.maximum(1.0, np.sqrt(counts))[row]
                g_b += float((error.mean()) ** 2)
                self.bias -= rate * error.mean() / np.sqrt(g_b)
                # gradients add up in the terms of this batch alone
                own, inverse = np.unique(at, return_inverse=True)
                gw = np.bincount(inverse, self_error, len(own)) + decay * self.weight[own]
                gv = np.stack([np.bincount(inverse, pair_error * (sums[row, f] - self.vector[at, f]), len(own)) for f in range(FACTORS)], 1) + decay * self.vector[own]
                g_w[own] += gw**2
                g_v[own] += gv**2
                self.weight[own] -= rate * gw / np.sqrt(g_w[own])
                self.vector[own] -= 0.1 * rate * gv / np.sqrt(g_v[own])
        self.weight, self.vector = self.weight.astype(np.float32), self.vector.astype(np.float32)

    @staticmethod
    def _chi(have: np.ndarray, both: np.ndarray, n: int, toxic: float) -> np.ndarray:
        """Chi-square with the label; have, both: rows, and toxic rows, of each bin."""
        cross = both * (n - have - toxic + both) - (have - both) * (toxic - both)
        return n * cross**2 / np.maximum(have * (n - have) * toxic * (n - toxic), 1)

    @staticmethod
    def _counts(bins: list[np.ndarray], rows: np.ndarray, size: int) -> np.ndarray:
        """How many of the rows have each bin."""
        out = np.zeros(size)
        for a in range(0, len(rows), CHUNK):
            out += np.bincount(np.concatenate([bins[i] for i in rows[a : a + CHUNK]]), minlength=size)
        return out

    @classmethod
    def _learned(cls, bins: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
        """Which bins go with the label more than chance explains, alone or next to one that does; without this, rare words fit the training rows."""
        every, toxic = np.arange(len(bins)), np.flatnonzero(labels > 0)
        have = cls._counts(bins, every, size)
        chi = cls._chi(have, cls._counts(bins, toxic, size), len(bins), len(toxic))
        often = have >= LEAST_ROWS
        alone = often & (chi >= LEAST_CHI)
        partners = np.flatnonzero(alone)
        partners = partners[np.argsort(-chi[partners], kind="stable")[:PARTNERS]]
        number = np.full(size, -1, np.int32)
        number[partners] = np.arange(len(partners))
        of: list[list[int]] = [[] for _ in partners]
        for i, b in enumerate(bins):
            for k in number[b][number[b] >= 0].tolist():
                of[k].append(i)
        least, out = LEAST_CHI + 2 * np.log(max(1, len(partners) * int(often.sum()))), alone.copy()
        for near in map(np.array, of):
            bad = near[labels[near] > 0]
            if len(near) >= least and 0 < len(bad) < len(near):  # a chi-square is never above the number of rows
                have = cls._counts(bins, near, size)
                out |= often & (have >= LEAST_ROWS) & (cls._chi(have, cls._counts(bins, bad, size), len(near), len(bad)) >= least)
        return out

    def _scores(self, at: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each row, and the sums of its vectors."""
        linear = np.bincount(row, self.weight[at], rows)
        v = self.vector[at]
        sums = np.stack([np.bincount(row, v[:, f], rows) for f in range(FACTORS)], 1)
        squares = np.bincount(row, (v * v).sum(axis=1), rows)
        pairs = 0.5 * ((sums**2).sum(axis=1) - squares)
        # pairs grow with the square of a text's terms; their share is kept to that of single terms
        scale = np.maximum(1.0, np.sqrt(np.bincount(row, minlength=rows)))
        z = self.bias + linear + pairs / scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), sums

    def score(self, column) -> np.ndarray:
        row, at = terms(column)
        at = self.place[at]
        known = at >= 0
        return self._scores(at[known], row[known], len(column))[0]


def train(docs: DataFrame, *, text: str = "text", label: str = "toxic", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted to at most ``sample_rows`` rows with label 0 or 1.

    Only hashed terms of the chosen rows come to the driver.  Rows with a null
    label teach nothing; without any label every score is one half.
    """
    rows = docs.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"), (F.col(f"`{label}`").cast("double") > 0).cast("int").alias("__label"))
    key = F.xxhash64(F.lit(3), "__id", "__text")
    count = rows.count()
    if count > sample_rows:  # a hash threshold leaves a little more than wanted, the limit cuts it exactly
        resolution = 1 << 30
        rows = rows.where(F.pmod(key, F.lit(resolution)) < F.lit(min(resolution, resolution * (sample_rows + 6 * int(sample_rows**0.5)) // count)))

    def make():
        def run(column):
            row, at = terms(column)
            return [lists(at.astype(np.int32), np.bincount(row, minlength=len(column)), pa.int32())]

        return run

    made = extended(rows.withColumn("__key", key), "__text", [T.StructField("__bins", T.ArrayType(T.IntegerType()))], make, ["__label", "__key"], limit=PIECE // 4)
    table = made.orderBy("__key").limit(sample_rows).toArrow()
    bins = table.column("__bins").combine_chunks()
    if isinstance(bins, pa.ChunkedArray):
        bins = pa.concat_arrays(bins.chunks) if bins.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat, edges = bins.values.to_numpy(), bins.offsets.to_numpy()
    machine = Machine([flat[a:b] for a, b in zip(edges, edges[1:])], table.column("__label").to_numpy().astype(np.float64))
    del table, bins, flat
    trim()
    return machine


def score(docs: DataFrame, machine: Machine, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score is 0.5 or more).

    Null and empty texts, and texts of unknown terms, score what the trained bias
    alone says; after training without labels that is one half.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        learned: Machine = sent.value

        def run(column):
            p = learned.score(column)
            return [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]

        return run

    return extended(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, carry, limit=PIECE // 4)


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """id, text and label of the labelled rows; an id labelled several times counts as its largest label."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias(label))
    return docs.select(id_col, "text").join(one, id_col)


def remainder(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


def clean(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; columns as before."""
    known = labelled(docs, labels)
    machine = train(known.where(remainder(F.col("doc_id"), 5) != 0))
    # under names of their own, so that no column of docs is replaced
    names = [f"c{k}" for k in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    scored = score(renamed, machine, text=names[docs.columns.index("text")], carry=names)
    return scored.where(F.col("score") < threshold).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
