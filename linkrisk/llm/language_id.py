"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over folded bytes.  In a context that has been
seen, a symbol has its count, and the number of different symbols counts as the
escape (method C); an escape goes on to the next shorter context, in which the
symbols of the longer one are excluded.  The statistics are frozen after
training, so the trees are compiled into exact code lengths of the (context,
symbol) that some language has seen and an escape length of each context; both
are sorted arrays, whose size follows what was seen and not the alphabet.  A
text's score in a language is the sum of its bytes' code lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import buffers, extended, pieces

#: The longest context, in bytes.
ORDER = 3
#: Documents of a language that training looks at (about; whole texts).
SAMPLE_DOCS = 1500
#: Languages that are learned: those with the most labelled rows, by name among equals.
LANGUAGES = 256
#: Code lengths (of a byte in a language) that are looked up at a time.
STEP = 1 << 20
#: Log2 of what is left for symbols that a full context has not seen.
NOTHING = float(np.log2(1e-12))
#: No language, for texts without a letter.
NONE = "und"

_BYTE = np.arange(256)
#: a-z (either case) 1..26, bytes of non-ASCII characters 27..154, all else 0.
FOLD = np.where((_BYTE >= 97) & (_BYTE <= 122), _BYTE - 96, np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE - 64, np.where(_BYTE >= 128, _BYTE - 101, 0)))
CLASSES = 155


def _codes(symbols: np.ndarray, offsets: np.ndarray, order: int, classes: int) -> np.ndarray:
    """For each byte the number of (its ``order`` predecessors, itself); before a text stand zeros."""
    out = symbols.astype(np.int64)
    begin = offsets[:-1][np.diff(offsets) > 0]
    for back in range(1, min(order, len(symbols)) + 1):
        earlier = np.zeros(len(symbols), np.int64)
        earlier[back:] = symbols[:-back]
        for k in range(back):
            # the byte ``back`` before the k-th of a text is not in it; a text of k bytes or fewer has no k-th
            at = begin + k
            earlier[at[at < len(symbols)]] = 0
        out += earlier * classes**back
    return out


class Trees:
    """Compiled context trees of all languages."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each language, codes over CLASSES symbols of (context, symbol) and how often each came."""
        self.languages = languages
        used = {0}
        for codes, _ in counts:
            for k in range(ORDER + 1):
                used |= set(np.unique(codes // CLASSES**k % CLASSES).tolist())
        names = np.array(sorted(used))
        self.classes = k = len(names) + 1  # the last is any symbol that training never saw
        small = np.full(CLASSES, k - 1)
        small[names] = np.arange(len(names))
        self.symbol = small[FOLD].astype(np.int32)
        self.order = ORDER
        size = len(languages)
        # lengths[m]: of each code of order m, by language; escapes[m]: of each context
        self.codes, self.lengths, self.contexts, self.escapes = [], [], [], []
        uniform = np.full((1, size), -np.log2(k))
        for order in range(ORDER + 1):
            own = []
            for codes, n in counts:
                short, at = np.unique(sum(small[codes // CLASSES**j % CLASSES] * k**j for j in range(order + 1)), return_inverse=True)
                own.append((short, np.bincount(at, n, len(short))))
            every = np.unique(np.concatenate([c for c, _ in own])) if own else np.empty(0, np.int64)
            contexts, of = np.unique(every // k, return_inverse=True)
            shorter = self.lengths[-1][np.searchsorted(self.codes[-1], every % k**order)] if order else np.repeat(uniform, len(every), axis=0)
            lengths, escapes = np.empty((len(every), size)), np.zeros((len(contexts), size))
            for x, (codes, n) in enumerate(own):
                at = np.searchsorted(every, codes)
                total, kinds = np.bincount(of[at], n, len(contexts)), np.bincount(of[at], minlength=len(contexts))
                left = 1 - np.bincount(of[at], np.exp2(shorter[at, x]), len(contexts))
                full = (kinds == k) | (left <= 1e-12)
                known = total > 0
                escape = kinds[known] / (total + kinds)[known] / np.maximum(left[known], 1e-12)
                escapes[known, x] = np.where(full[known], NOTHING, np.log2(escape))
                lengths[:, x] = escapes[of, x] + shorter[:, x]
                lengths[at, x] = np.log2(n / (total + np.where(full, 0, kinds))[of[at]])
            self.codes.append(every)
            self.lengths.append(lengths)
            self.contexts.append(contexts)
            self.escapes.append(escapes)
        self.uniform = uniform.astype(np.float32)
        self.lengths = [x.astype(np.float32) for x in self.lengths]
        self.escapes = [x.astype(np.float32) for x in self.escapes]

    @staticmethod
    def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def look(self, codes: np.ndarray) -> np.ndarray:
        """(codes, languages): log2 probability of each (context, symbol) of the longest context."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        open_ = np.arange(len(codes))
        for order in range(self.order, -1, -1):
            code = codes[open_] % self.classes ** (order + 1)
            at, hit = self._found(self.codes[order], code)
            out[open_[hit]] += self.lengths[order][at[hit]]
            open_, code = open_[~hit], code[~hit]
            if not len(open_):
                return out
            # the others escape, and look at the next shorter context
            at, hit = self._found(self.contexts[order], code // self.classes)
            out[open_[hit]] += self.escapes[order][at[hit]]
        out[open_] += self.uniform
        return out

    @property
    def bits(self) -> np.ndarray:
        """The lengths of all codes, seen or not (for small alphabets)."""
        return self.look(np.arange(self.classes ** (self.order + 1)))

    def totals(self, column) -> np.ndarray:
        """(rows, languages): log2 probability of each text."""
        data, offsets = buffers(column)
        codes = _codes(self.symbol[data], offsets, self.order, self.classes)
        out = np.zeros((len(offsets) - 1, len(self.languages)), np.float64)
        step = max(1, STEP // len(self.languages))
        for a in range(0, len(codes), step):
            b = min(len(codes), a + step)
            # rows that have bytes in this step; each one's sum begins where it does
            first, end = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
            rows = np.arange(first, end)
            rows = rows[offsets[rows + 1] > np.maximum(offsets[rows], a)]
            out[rows] += np.add.reduceat(self.look(codes[a:b]), np.maximum(offsets[rows], a) - a, axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, most_languages: int = LANGUAGES) -> Trees:
    """Trees from a bounded sample of the labelled rows.

    About ``sample_docs`` documents of each language, chosen by a hash of id and
    text; counts are made on the executors and only (context, symbol, count)
    comes back.  At most ``most_languages`` are learned, those with the most rows.
    Rows with a null language or text teach nothing.
    """
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.lit(5), F.col(f"`{id_col}`"), F.octet_length(F.col(f"`{text}`").cast("string"))).alias("key")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return Trees([], [])
    resolution = 1 << 30
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, min(resolution, resolution * sample_docs // sizes[x] + 1))])[F.col("lang")]
    sample = rows.where(F.pmod("key", F.lit(resolution)) < share).select("lang", "text")

    def count(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                names = np.array(piece.column("lang").to_pylist())
                for x in np.unique(names):
                    data, offsets = buffers(piece.column("text").filter(pa.array(names == x)))
                    codes, n = np.unique(_codes(FOLD[data], offsets, ORDER, CLASSES), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(x)] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    counted = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names = counted.column("lang").to_numpy(zero_copy_only=False) if counted.num_rows else np.array([], object)
    codes, n = counted.column("code").to_numpy(), counted.column("n").to_numpy()
    return Trees(languages, [(codes[names == x], n[names == x]) for x in languages])


def identify(docs: DataFrame, trees: Trees, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, in the place of columns of these names.

    The language with the shortest code wins, the first by name on ties.  score
    is its share of probability among all languages, each as likely beforehand.
    Null texts and texts without a letter, and all texts if no language was
    learned, are ``und`` with score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def make():
        learned: Trees = sent.value

        def run(column):
            if not learned.languages:
                return [pa.array([NONE] * len(column)), pa.array([0.0] * len(column))]
            totals = learned.totals(column)
            best = totals.argmax(axis=1)
            over = np.exp2(np.maximum(totals - totals.max(axis=1, keepdims=True), -1000)).sum(axis=1)
            return [pa.array([learned.languages[b] for b in best.tolist()], pa.string()), pa.array(1 / over)]

        return run

    body = F.col(f"`{text}`").cast("string")
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], body.alias("body"), F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    out = extended(rows, "body", fields, make, [*[f"c{i}" for i in range(len(names))], "lettered"])
    known = lambda c, other: F.when(F.col("lettered"), F.col(c)).otherwise(F.lit(other)).alias(c)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], known("lang_pred", NONE), known("score", 0.0))
