"""Language-model scoring with a weighted backoff automaton and distributed n-grams.

Unigram counts are exact and cover the whole vocabulary.  Longer n-grams are kept
from ``LEAST`` occurrences on, whatever the size of the corpus.  All of them stay
distributed; the most frequent, of a share ``head_share`` of the tokens or more
(never more than 1/head_share of an order), are also compiled into an automaton that
is sent to the executors.

States are the histories that have arcs; a state's failure arc leads to its
longest proper suffix and carries the mass that interpolated absolute
discounting leaves for it.  One traversal from left to right carries the state
and adds up log-probabilities; as a state is at most order - 1 words long, all
places of a batch take the same step of it at a time.

Texts are stored once as numbers of words (see :class:`Coder`), from which longer
n-grams are counted and asked for.

A text's score is a sum over its n-grams: each kept n-gram changes the
log-probability of its last word by a fixed amount, and that of the next word by
the mass it leaves.  So what the automaton does not hold is looked up by hash in
partitions of bounded size, and one number for each text comes back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import LOWER, NON_SPACE, U64, Lookup, Words, buffers, cut, forget, mix, pieces, release, stored, trim

#: Longest n-gram; share of the training tokens from which a word, or a longer n-gram, is part of the automaton.
ORDER, WORD_SHARE, HEAD_SHARE = 3, 1e-6, 1e-5
#: Longer n-grams are kept from so many occurrences on.
LEAST = 2
#: What absolute discounting takes from a count; what is added to each count of a single word.
DISCOUNT, ADDED = 0.75, 0.1
#: Tokens whose counts are put together before they leave a task.
FLUSH = 1 << 21
#: Tokens whose longer n-grams meet in one partition (about); bytes of tokens (four of each) whose n-grams leave a task together.
PART, BYTES = 1 << 19, 4 << 20
#: Bytes of text whose words are hashed together: what they need stays in the processor's cache.
STEP = 1 << 19
#: Parquet's switch of dictionaries, which hashes have no use for.
PLAIN = "parquet.enable.dictionary"
#: The hash of the end token (a fixed value).
END = U64(0x0E0D0E0D0E0D0E0D)


def token_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then one end for each text), and where each text begins."""
    steps = [_step_hashes(x.column(0)) for x in pieces(pa.RecordBatch.from_arrays([column], names=["text"]), "text", STEP)]
    if not steps:
        return np.empty(0, U64), np.zeros(1, np.int64)
    begins = np.cumsum([0, *[len(h) for h, _ in steps]])
    return np.concatenate([h for h, _ in steps]), np.concatenate([*[first[:-1] + at for (_, first), at in zip(steps, begins)], begins[-1:]])


def _step_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    words = Words(column, NON_SPACE, LOWER)
    rows = len(column)
    out = np.empty(len(words) + rows, U64)
    first = np.append(words.first[:-1] + np.arange(rows), len(out))
    word = np.ones(len(out), bool)
    word[first[1:] - 1] = False
    out[word] = words.hashes()
    out[~word] = END
    return out, first


def word_counts(train: DataFrame) -> DataFrame:
    """hash, c of every token of the training texts (column ``text``)."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                held.append(token_hashes(piece.column(0))[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield _rows(held)
                    held, size = [], 0
        if size:
            yield _rows(held)
        trim()

    return train.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("c"))


def _rows(held: list[np.ndarray]) -> pa.RecordBatch:
    found, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])


class Ids(Lookup):
    """Numbers of the words of the automaton: 0, 1, ... by hash; -1 for all others."""

    def __init__(self, hashes: np.ndarray):
        super().__init__(np.sort(hashes.astype(U64)))
        self.hashes = self.keys


#: Columns of a text's tokens: the bytes of the words' numbers, and the hashes of words that have none.
CODED = ["low", "mid", "high", "rare"]
CODED_TYPE = ", ".join(f"{c} binary" for c in CODED)


class Coder:
    """Tokens as numbers: 1, 2, ... for the words of ``ids`` by descending count, 0 for all others, whose hashes stand beside them."""

    def __init__(self, ids: Ids, counts: np.ndarray):
        by = np.argsort(-counts, kind="stable")
        self.hash_of = np.append(U64(0), ids.hashes[by])
        self.number_of = np.zeros(len(by) + 1, "<u4")  # that of id -1 is the last, 0
        self.number_of[by] = np.arange(1, len(by) + 1)

    def columns(self, h: np.ndarray, w: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        """Tokens with hashes ``h`` and ids ``w`` as the columns of CODED, a row for each text."""
        number = self.number_of[w]
        planes = number.view(np.uint8).reshape(-1, 4).T
        rare = number == 0
        return [*[_binary(plane, first) for plane in planes[:3]], _binary(h[rare], 8 * np.append(0, np.cumsum(rare))[first])]


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _tokens(batch: pa.RecordBatch, hash_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, where each text begins, numbers) of the tokens in the columns of CODED."""
    (low, first), (mid, _), (high, _), (rare, _) = (buffers(batch.column(batch.schema.get_field_index(c))) for c in CODED)
    number = low | mid.astype("<u4") << 8 | high.astype("<u4") << 16
    h = hash_of[number]
    h[number == 0] = rare.view(U64)
    return h, first, number


def coded(texts: DataFrame, coder: Coder, ids: Ids) -> DataFrame:
    """The tokens of the texts (column ``text``) in the columns of CODED."""
    sent = texts.sparkSession.sparkContext.broadcast((coder, ids))

    def code(batches):
        coder, ids = sent.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, first = token_hashes(piece.column(0))
                yield pa.RecordBatch.from_arrays(coder.columns(h, ids.of(h), first), names=CODED)
        trim()

    return texts.select("text").mapInArrow(code, CODED_TYPE)


def _room(first: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(first[1:], np.diff(first)) - np.arange(n)


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams from those of their first and last n-1 words."""
    return mix(a * U64(0x9E3779B97F4A7C15) + b + U64(n))


def _grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the first n-1 words, hash of the last n-1, place) of all n-grams inside texts."""
    before, whole = h, h
    for m in range(2, n + 1):
        before, whole = whole, _joined(whole[:-1], whole[1:], m)
    at = np.flatnonzero(_room(first, len(h))[: len(whole)] >= n)
    return whole[at], before[at], before[at + 1], at


def _parts(tokens: int) -> int:
    return min(1 << 16, max(1, tokens // PART))


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U64(48)) * U64(parts) >> U64(16)).astype(np.uint16)


def _dealt(part: np.ndarray):
    """(part, from, to) of each run of equal numbers."""
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    return zip(part[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(part)])


def _order(h: np.ndarray) -> np.ndarray:
    """The places of hashes in ascending order, as np.argsort has them: sorted as numbers of their first bits and their place."""
    if len(h) < 2:
        return np.arange(len(h))
    low = h.min()
    free = U64(64 - int(h.max() - low).bit_length())
    place = U64((1 << len(h).bit_length()) - 1)
    by = np.sort((h - low << free) & ~place | np.arange(len(h), dtype=U64))
    by = (by & place).astype(np.int64)
    found = h[by]
    return by if (found[1:] >= found[:-1]).all() else np.argsort(h)  # some share all those first bits


def _summed(h: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None):
    """The distinct hashes in ascending order, with a, b and the sum of n (without n: how often each is there)."""
    by = _order(h)
    h = h[by]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    c = np.diff(new, append=len(h)) if n is None else np.add.reduceat(n[by], new) if len(h) else n
    own = by[new]
    return h[new], a[own], b[own], c


#: Odd multipliers that stir numbers, and their inverses.
_STIR = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_BACK = [pow(m, -1, 1 << 64) for m in reversed(_STIR)]


def _stirred(x: np.ndarray, bits: int, by: list[int] = _STIR) -> np.ndarray:
    """Numbers of so many bits, one to one as others that look random; with _BACK the way back."""
    half, low = U64((bits + 1) // 2), U64((1 << bits) - 1)
    for m in by:
        x = (x ^ x >> half) * U64(m) & low
    return x ^ x >> half


def _inside(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """For each token but the last n-1: whether the n tokens from it on are of one text."""
    inside = np.ones(size, bool)
    for k in range(n - 1):
        last = first[1:] - 1 - k
        inside[last[last >= 0]] = False
    return inside[: max(0, size - n + 1)]


def _hash_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams from these places on."""
    return h[at] if n == 1 else _joined(_hash_at(h, at, n - 1), _hash_at(h, at + 1, n - 1), n)


def _least_of(part: int, parts: int, bits: int) -> int:
    """The least number of so many bits that belongs to a part."""
    return -(-(part << 16) // parts) << bits - 16


def _size(x: np.ndarray) -> int:
    """Bytes (1, 2, 4 or 8) that hold each of the numbers."""
    top = int(x.max())
    return next(k for k in (1, 2, 4, 8) if top < 1 << 8 * k)


def gram_counts(tokens_of: DataFrame, coder: Coder, n: int, least: float, tokens: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """h, a, b, c: the n-grams of at least ``least`` occurrences; a, b: hashes of their first and last n-1 words.

    Of all n-grams (tokens_of: as :func:`coded` gives them) those whose hash, or
    code, leaves the remainder ``turn``: turns need less disk at a time.  Where
    all words have numbers and these fit into 64 bits, the n-gram is counted as
    its code: the numbers side by side, stirred.  Codes leave a task in ascending
    order, as the steps between them.  All others are counted by hash.
    """
    parts = _parts(tokens // turns)
    width = (len(coder.hash_of) - 1).bit_length()
    bits = max(32, n * width)
    sent = tokens_of.sparkSession.sparkContext.broadcast(coder.hash_of)

    def codes(number, places):
        """(part, kind, size, data) of the codes from these places on; kind: bytes of a step's low part, its high part and a count."""
        code = np.zeros(len(places), U64)
        for k in range(n):
            code = code << U64(width) | number[places + k]
        code = _stirred(code, bits)
        if turns > 1:
            code = code[code % U64(turns) == turn]
        if not len(code):
            return []
        code.sort()
        new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        c, code = np.diff(new, append=len(code)), code[new]
        runs = list(_dealt((code >> U64(bits - 16)) * U64(parts) >> U64(16)))
        step = np.diff(code, prepend=U64(0))
        begins = [i for _, i, _ in runs]
        step[begins] = code[begins] - np.array([_least_of(p, parts, bits) for p, _, _ in runs], U64)
        low = 2 if _size(step) <= 4 else 4
        high = step >> U64(8 * low)
        sizes = low, _size(high), _size(c)
        planes = [x.astype(f"<u{k}") for x, k in zip((step, high, c), sizes)]
        kind = sizes[0] << 8 | sizes[1] << 4 | sizes[2]
        return [(p, kind, j - i, b"".join([x[i:j].tobytes() for x in planes])) for p, i, j in runs]

    def hashes(h, places):
        a, b = _hash_at(h, places, n - 1), _hash_at(h, places + 1, n - 1)
        h = _joined(a, b, n)
        if turns > 1:
            own = h % U64(turns) == turn
            h, a, b = h[own], a[own], b[own]
        h, a, b, c = _summed(h, a, b)
        return [(p, 0, j - i, b"".join([a[i:j].tobytes(), b[i:j].tobytes(), c[i:j].astype("<u4").tobytes()])) for p, i, j in _dealt(_part(h, parts))]

    def count(batches):
        hash_of = sent.value
        for batch in batches:
            for piece in pieces(batch, "low", max(1, BYTES // 4)):
                h, first, number = _tokens(piece, hash_of)
                inside = _inside(first, len(h), n)
                known = inside.copy() if n * width <= 64 else np.zeros(len(inside), bool)
                for k in range(n):
                    known &= number[k : k + len(inside)] > 0
                rows = [*codes(number, np.flatnonzero(known)), *hashes(h, np.flatnonzero(inside & ~known))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["part", "kind", "size", "grams"])
        trim()

    def add(batches):
        hashed, coded = [], {}
        for batch in batches:
            for p, kind, size, g in zip(*(x.to_pylist() for x in batch.columns)):
                if kind:
                    low, high, c = kind >> 8, kind >> 4 & 15, kind & 15
                    coded.setdefault(kind, []).append((p, size, np.frombuffer(g, f"<u{low}", size), np.frombuffer(g, f"<u{high}", size, low * size), np.frombuffer(g, f"<u{c}", size, (low + high) * size)))
                else:
                    hashed.append((np.frombuffer(g, U64, size), np.frombuffer(g, U64, size, 8 * size), np.frombuffer(g, "<u4", size, 16 * size)))
        if hashed:
            a, b, c = [np.concatenate(x) for x in zip(*hashed)]
            hashed.clear()
            h, a, b, c = _summed(_joined(a, b, n), a, b, c.astype(np.int64))
            keep = c >= least
            yield batch_of(h[keep], a[keep], b[keep], c[keep])
        if coded:
            code, c = [np.concatenate(x) for x in zip(*[read(kind, runs) for kind, runs in coded.items()])]
            coded.clear()
            by = _order(code)
            code = code[by]
            new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            c = np.add.reduceat(c[by], new)
            keep = c >= least
            code, c = _stirred(code[new[keep]], bits, _BACK), c[keep]
            number = [(code >> U64(width * k) & U64((1 << width) - 1)).astype(np.int64) for k in reversed(range(n))]
            words = [sent.value[x] for x in number]
            a, b = gram(words[:-1]), gram(words[1:])
            yield batch_of(_joined(a, b, n), a, b, c)
        trim()

    def gram(words):
        """Hashes of the n-grams with these first, second, ... words."""
        return words[0] if len(words) == 1 else _joined(gram(words[:-1]), gram(words[1:]), len(words))

    def read(kind, runs):
        p, size, low, high, c = zip(*runs)
        step = np.concatenate(low).astype(U64) | np.concatenate(high).astype(U64) << U64(8 * (kind >> 8))
        size = np.array(size)
        begin = np.cumsum(size) - size
        code = np.cumsum(step)
        code += np.repeat(np.array([_least_of(x, parts, bits) for x in p], U64) - (code[begin] - step[begin]), size)
        return code, np.concatenate(c).astype(np.int64)

    def batch_of(h, a, b, c):
        return pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in (h, a, b)], pa.array(c)], names=["h", "a", "b", "c"])

    return tokens_of.mapInArrow(count, "part int, kind int, size int, grams binary").repartition(parts, "part").mapInArrow(add, "h long, a long, b long, c long")


def _beside_words(grams: DataFrame, ids: Ids, counts: np.ndarray, lefts: np.ndarray) -> DataFrame:
    """Pairs of words with c_a and left_a of the first and c_b of the second; null where it is not one of ``ids``."""
    sent = grams.sparkSession.sparkContext.broadcast((ids.hashes, np.append(counts, 0.0), np.append(lefts, 1.0)))

    def look(batches):
        hashes, counts, lefts = sent.value
        known = Ids(hashes)
        for batch in batches:
            a, b = (known.of(batch.column(k).to_numpy().view(U64)) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts[a], mask=a < 0), pa.array(lefts[a], mask=a < 0), pa.array(counts[b], mask=b < 0)], names=["h", "a", "b", "c", "c_a", "left_a", "c_b"])
        trim()

    return grams.select("h", "a", "b", "c").mapInArrow(look, "h long, a long, b long, c long, c_a double, left_a double, c_b double")


class Automaton:
    """States, arcs and failure arcs, compiled on the driver from at most 1/head_share n-grams of each order."""

    def __init__(self, ids: Ids, counts: np.ndarray, grams: dict[int, tuple[np.ndarray, np.ndarray]], lefts: dict[int, np.ndarray], heads: dict[int, np.ndarray], tokens: int, kinds: int, least: float):
        """counts: of the words of ids, which occur ``least`` times or more; grams[n]: (codes, counts) of the n-grams that have arcs, n from 2 on.

        lefts[n]: what the kept n+1-grams, with arcs or not, leave of the mass of
        each word (n = 1) or n-gram; heads[n]: sorted hashes of the n-grams.
        """
        self.ids, self.heads, self.tokens, self.kinds, self.least = ids, heads, tokens, kinds, least
        self.coder = Coder(ids, counts)
        self.floor = tokens + ADDED * (kinds + 1)
        self.word = np.log10((counts + ADDED) / self.floor) if len(counts) else np.empty(0)
        self.unseen = float(np.log10(ADDED / self.floor))
        # a history of n words has a number among the n-grams; states are numbered over all lengths, the root is 0
        top = max(grams, default=1)
        sizes = [1, len(counts), *[len(grams[n][0]) for n in range(2, top)]]
        self.base = np.cumsum([0, *sizes])  # base[n]: state of the first history of n words
        total = int(self.base[-1])
        fail, left = np.zeros(total, np.int64), np.ones(total)
        chance = {1: (counts + ADDED) / self.floor}
        suffix = {1: np.zeros(len(counts), np.int64)}  # of a kept n-gram: number of its last n-1 words among the (n-1)-grams
        history_count = {1: counts}
        for n in range(2, top + 1):
            codes, found = grams[n]
            before, last = codes >> 24, codes & ((1 << 24) - 1)
            given = history_count[n - 1][before]
            kept = np.maximum(found - DISCOUNT, 0) / np.maximum(given, 1)
            left[self.base[n - 1] : self.base[n]] = lefts[n - 1]
            if n == 2:
                suffix[2] = last
                shorter = chance[1][last]
            else:  # its last n-1 words are at least as frequent, so they are kept too
                code = (suffix[n - 1][before] << 24) | last
                suffix[n] = np.searchsorted(grams[n - 1][0], code)
                shorter = chance[n - 1][suffix[n]]
            chance[n] = kept + left[self.base[n - 1] + before] * shorter
            history_count[n] = found
        for n in range(1, top):  # failure: the state of the longest proper suffix
            own = slice(int(self.base[n]), int(self.base[n + 1]))
            fail[own] = 0 if n == 1 else self.base[n - 1] + suffix[n]
        self.fail, self.weight = fail, np.log10(left)
        self.weight[0] = 0.0
        # the whole way down to the root, for a word that no arc carries
        down = np.zeros(total)
        for n in range(1, top):
            own = slice(int(self.base[n]), int(self.base[n + 1]))
            down[own] = self.weight[own] + down[fail[own]]
        self.down = down
        # arcs of the root are an array over the words; all others by (state, word)
        self.first = int(self.base[1]) if top > 1 else None
        source, to, value = [], [], []
        for n in range(2, top + 1):
            codes = grams[n][0]
            source.append(((self.base[n - 1] + (codes >> 24)) << 24) | (codes & ((1 << 24) - 1)))
            # an arc leads to the state of the whole n-gram, or of its longest suffix that is one
            to.append(self.base[n] + np.arange(len(codes)) if n < top else self.base[n - 1] + suffix[n])
            value.append(np.log10(chance[n]))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        self.source, self.to, self.value = join(source, np.int64), join(to, np.int64), join(value, np.float64)

    def ready(self) -> None:
        """Makes the lookup of arcs; it is not sent, each worker makes its own."""
        if not hasattr(self, "arcs"):
            codes = mix(self.source.astype(U64))
            by = np.argsort(codes)
            self.by, self.arcs = by, Lookup(codes[by])

    def arc(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The arc of each state and word, -1 where there is none."""
        at = self.arcs.of(mix((state.astype(U64) << U64(24)) | word.astype(U64)))
        return np.where(at >= 0, self.by[at], -1) if len(self.by) else at

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("arcs", "by")}


def traverse(machine: Automaton, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log10-probability of the tokens of each text, without the last step of words that have no number (-1).

    first: where each text begins, and the end.  All places take a step at a time.
    """
    machine.ready()
    n, known = len(words), words >= 0
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    later = np.flatnonzero(known & ~begins[:-1])
    before = lambda state: np.where(begins[:-1], 0, np.concatenate([[0], state[:-1]])) if n else state
    # the state after each token: of the longest history of 1, 2, ... words that has arcs
    state = np.where(known, machine.first + words, 0) if machine.first else np.zeros(n, np.int64)
    for _ in range(2, len(machine.base) - 1):
        from_, longer = before(state)[later], state.copy()
        inner = from_ > 0
        arc = machine.arc(from_[inner], words[later[inner]])
        longer[later[inner][arc >= 0]] = machine.to[arc[arc >= 0]]
        state = longer
    now = before(state)
    value = np.where(known, 0.0, machine.down[now])
    left = later[now[later] > 0]
    single = known.copy()
    while len(left):
        arc = machine.arc(now[left], words[left])
        hit = arc >= 0
        value[left[hit]] += machine.value[arc[hit]]
        single[left[hit]] = False
        left = left[~hit]  # these fail to a shorter history
        value[left] += machine.weight[now[left]]
        now[left] = machine.fail[now[left]]
        left = left[now[left] > 0]
    if len(machine.word):
        value[single] += machine.word[words[single]]
    total = np.concatenate([[0.0], np.cumsum(value)])
    return total[first[1:]] - total[first[:-1]]


def train(docs: DataFrame, *, text: str = "text", order: int = ORDER, word_share: float = WORD_SHARE, share: float = 0.0, head_share: float = HEAD_SHARE) -> tuple[dict[int, DataFrame], Automaton]:
    """(for each n the table of all kept n-grams; the automaton of the frequent ones).

    Tables have h (hash) and s (what the n-gram adds to a text's score); that of
    words also c, left (the share of mass that longer n-grams leave) and p.  All words are kept, and longer n-grams of ``LEAST`` occurrences or
    more; ``share`` drops those below a share of the tokens as well (none by
    default).
    """
    if 1 / word_share > (1 << 24) - 1:
        raise ValueError("word_share is too small for the numbers of words")
    rows = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    counts, counts_at = stored(word_counts(rows), "lm-counts1")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = int(total["n"]), int(total["v"])
    floor = tokens + ADDED * (kinds + 1)
    column = lambda found, name: found.column(name).to_numpy()
    of_machine = F.col("c") >= max(LEAST, word_share * tokens)
    found = counts.where(of_machine).toArrow()
    ids = Ids(column(found, "hash").view(U64))
    coder = Coder(ids, column(found, "c")[np.argsort(column(found, "hash").view(U64))])
    # n-grams are counted over the words' numbers: texts are read and hashed once for all of them
    tokens_of, tokens_at = stored(coded(rows, coder, ids), "lm-tokens", {PLAIN: "false"})
    kept, dead = {}, {n: [] for n in range(1, order + 1)}
    for n in range(2, order + 1):
        for turn in range(n - 1):
            part, at = stored(gram_counts(tokens_of, coder, n, max(LEAST, share * tokens), tokens, turn, n - 1), f"lm-counts{n}", {PLAIN: "false"})
            dead[n].append(at)
            kept[n] = kept[n].unionByName(part) if turn else part
            release(spark)
    forget(spark, tokens_at)

    def with_left(table: DataFrame, n: int) -> DataFrame:
        if n + 1 not in kept:
            return table.withColumn("left", F.lit(1.0))
        mass = kept[n + 1].groupBy(F.col("a").alias("h")).agg(F.sum(F.col("c") - F.lit(DISCOUNT)).alias("mass"))
        return table.join(mass.hint("shuffle_hash"), "h", "left").withColumn("left", F.greatest(F.lit(1e-9), 1 - F.coalesce("mass", F.lit(0.0)) / F.col("c"))).drop("mass")

    tables, at = {}, {}
    words, at[1] = stored(with_left(counts.withColumnRenamed("hash", "h"), 1), "lm-grams1", {PLAIN: "false"})
    tables[1] = words.withColumn("p", (F.col("c") + F.lit(ADDED)) / F.lit(floor)).withColumn("s", F.log10("p") + F.log10("left"))
    forget(spark, counts_at)
    found = words.where(of_machine).toArrow()
    by = np.argsort(column(found, "h").view(U64))
    word_n, lefts = column(found, "c")[by].astype(np.float64), {1: column(found, "left")[by]}
    heads_of = {}
    for n in range(2, order + 1):
        # words are looked up by their hashes, each join leaving out what is done with; keys of the hashed sides are unique
        shorter = tables[n - 1]
        frequent = F.col("c") >= max(LEAST, head_share * tokens, word_share * tokens)
        grams = kept[n]
        if n == 2:  # most pairs are of words that every task can look up itself
            grams = _beside_words(grams, ids, word_n, lefts[1])
            near = F.col("c_a").isNotNull() & F.col("c_b").isNotNull()
            done = grams.where(near).withColumn("p_b", (F.col("c_b") + F.lit(ADDED)) / F.lit(floor))
            grams = grams.where(~near).select("h", "a", "b", "c")
        last = shorter.select(F.col("h").alias("b"), F.col("p").alias("p_b")).hint("shuffle_hash")
        history = shorter.select(F.col("h").alias("a"), F.col("c").alias("c_a"), F.col("left").alias("left_a")).hint("shuffle_hash")
        table = grams.join(last, "b").select("h", "a", F.when(frequent, F.col("b")).alias("b"), "c", "p_b").join(history, "a")
        if n == 2:
            table = table.unionByName(done.select("h", "a", F.when(frequent, F.col("b")).alias("b"), "c", "p_b", "c_a", "left_a"))
        table = table.withColumn("p", (F.col("c") - F.lit(DISCOUNT)) / F.col("c_a") + F.col("left_a") * F.col("p_b"))
        table = table.select("h", F.when(frequent, F.col("a")).alias("a"), "b", "c", "p", (F.log10("p") - F.log10("left_a") - F.log10("p_b")).alias("s"))
        table = with_left(table, n).withColumn("s", F.col("s") + F.log10("left"))
        if n < order:
            table = table.select("h", "a", "b", "c", "left", "p", "s")
        else:  # texts ask for the hash and the score
            table = table.select("h", "a", "b", *[F.when(frequent, F.col(c)).alias(c) for c in ("c", "left")], "s")
        tables[n], at[n] = stored(table, f"lm-grams{n}", {PLAIN: "false"})
        for path in dead[n]:
            forget(spark, path)
        heads_of[n] = tables[n].where(F.col("a").isNotNull()).select("h", "a", "b", "c", "left").toArrow()
        if n > 2:  # what a text asks for is the hash and the score; the rest was for the next order
            slim, path = stored(tables[n - 1].select("h", "s"), f"lm-scores{n - 1}", {PLAIN: "false"})
            forget(spark, at[n - 1])
            tables[n - 1], at[n - 1] = slim, path
        release(spark)
    if order > 1:
        tables[order] = tables[order].select("h", "s")

    grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heads: dict[int, np.ndarray] = {}
    shorter, last = ids, np.arange(len(word_n))  # numbers of the shorter n-grams by hash; their last words
    number = last
    for n in range(2, order + 1):
        # the parts of an n-gram are as frequent as it is, so they are found
        found = heads_of[n]
        h, before, after = (column(found, x).view(U64) for x in "hab")
        place = shorter.of(after)
        codes = (number[shorter.of(before)] << np.int64(24)) | last[place] if len(h) else np.empty(0, np.int64)
        by = np.argsort(codes)
        grams[n], lefts[n] = (codes[by], column(found, "c")[by].astype(np.float64)), column(found, "left")[by]
        shorter = Ids(h)
        heads[n] = shorter.hashes
        own = np.empty(len(h), np.int64)
        own[by] = np.arange(len(h))
        at = np.argsort(h)
        number, last = own[at], (codes & ((1 << 24) - 1))[at]
    return tables, Automaton(ids, word_n, grams, lefts, heads, tokens, kinds, max(LEAST, word_share * tokens))


def _steps(row: np.ndarray) -> bytes:
    """Ascending numbers as the steps between them, all low bytes before all high ones: shuffle files compress them."""
    return np.diff(row, prepend=row.dtype.type(0)).view(np.uint8).reshape(-1, 2).T.tobytes()


def _keys(h: np.ndarray, wide: bool) -> bytes:
    """Hashes as bytes: their last four of each, then two more; ``wide``: all eight of each."""
    return h.astype("<u8").tobytes() if wide else h.astype("<u4").tobytes() + (h >> U64(32)).astype("<u2").tobytes()


def _read_keys(keys: bytes, wide: bool) -> np.ndarray:
    """What _keys wrote, as the first bits of a hash."""
    if wide:
        return np.frombuffer(keys, "<u8")
    n = len(keys) // 6
    return np.frombuffer(keys, "<u4", n).astype(U64) << U64(16) | np.frombuffer(keys, "<u2", n, 4 * n).astype(U64) << U64(48)


def _tails(texts: DataFrame, table: DataFrame, n: int, machine: Automaton, tokens: int) -> DataFrame:
    """row and, of each other column of ``table`` (h, numbers), the sum over a text's n-grams that have no arc.  texts: row, tokens (CODED).

    Hashes are dealt out by their first bits; in a part, 48 bits tell them apart,
    and all 64 those of single words.  An n-gram that is so frequent that it
    would crowd a part has an arc.
    """
    parts = _parts(tokens // 4 if n == 1 else tokens)  # rare words are few beside longer n-grams
    sent = texts.sparkSession.sparkContext.broadcast((machine.heads.get(n), machine.coder.hash_of))
    sums_of = [c for c in table.columns if c != "h"]
    names = ["part", "block", "keys", "more"]
    schema = "part int, block long, keys binary, more binary"

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    def ask(batches):
        heads, hash_of = sent.value
        known = None if n == 1 else Ids(heads)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), len(ids)]
            for i, j in zip(edges, edges[1:]):  # runs of following row numbers: a block is named by its first
                for k in range(i, j, 1 << 16):
                    for piece in pieces(batch.slice(k, min(j - k, 1 << 16)), "low", max(1, BYTES // 4)):
                        h, first, number = _tokens(piece, hash_of)
                        g, at = (h, np.arange(len(h))) if n == 1 else _grams(h, first, n)[::3]
                        row = np.repeat(np.arange(piece.num_rows).astype("<u2"), np.diff(first))
                        out = np.flatnonzero(number == 0 if n == 1 else known.of(g) < 0)
                        g = g[out]
                        part = _part(g, parts)
                        by = np.argsort(part, kind="stable")
                        g, row = g[by], row[at[out[by]]]
                        block = piece.column(0)[0].as_py()
                        yield batch_of([(p, block, _keys(g[x:y], n == 1), _steps(row[x:y])) for p, x, y in _dealt(part[by])])
        trim()

    def tell(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(U64)
            by = _order(h)
            h, s = h[by], np.stack([x.to_numpy()[by] for x in batch.columns[1:]])
            yield batch_of([(p, None, _keys(h[x:y], n == 1), s[:, x:y].tobytes()) for p, x, y in _dealt(_part(h, parts))])

    def meet(batches):
        keys, values, asked = {}, {}, {}
        for batch in batches:
            for p, block, k, more in zip(*(batch.column(x).to_pylist() for x in range(4))):
                if block is None:
                    keys.setdefault(p, []).append(_read_keys(k, n == 1))
                    values.setdefault(p, []).append(np.frombuffer(more, np.float64).reshape(len(sums_of), -1))
                else:
                    asked.setdefault(p, []).append((block, k, more))
        for p, questions in asked.items():
            if p not in keys:
                continue
            key, value = np.concatenate(keys.pop(p)), np.concatenate(values.pop(p), axis=1)
            by = _order(key)
            value, known = value[:, by], Lookup(key[by])
            rows = []
            for block, k, more in questions:
                at = known.of(_read_keys(k, n == 1))
                hit = at >= 0
                row = np.cumsum(np.frombuffer(more, np.uint8).reshape(2, -1).T.reshape(-1).view("<u2"), dtype="<u2")[hit]
                if len(row):
                    new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    rows.append((p, block, row[new].tobytes(), np.add.reduceat(value[:, at[hit]], new, axis=1).tobytes()))
            if rows:
                yield batch_of(rows)
        trim()

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, k, more in zip(*(batch.column(x).to_pylist() for x in (1, 2, 3))):
                row = np.frombuffer(k, "<u2")
                have = sums.get(block, np.zeros((len(sums_of), 0)))
                if have.shape[1] <= row[-1]:
                    have = sums[block] = np.pad(have, ((0, 0), (0, int(row[-1]) + 1 - have.shape[1])))
                have[:, row] += np.frombuffer(more, np.float64).reshape(len(sums_of), -1)
        for block, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(block + np.arange(s.shape[1])), *[pa.array(x) for x in s]], names=["row", *sums_of])

    asked = texts.select("row", *CODED).mapInArrow(ask, schema)
    told = table.select("h", *[F.col(c).cast("double") for c in sums_of]).mapInArrow(tell, schema)
    met = asked.unionByName(told).repartition(parts, "part").mapInArrow(meet, schema)
    return met.repartition(max(1, parts // 8), "block").mapInArrow(add, ", ".join(["row long", *[f"{c} double" for c in sums_of]]))


def score(docs: DataFrame, model: tuple[dict[int, DataFrame], Automaton], *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of ``docs`` (all but the text by default) with n_tokens, n_known, train_tokens, base_score, score.

    Null counts as the empty text, which is one end token.  Rows stay apart even
    if they are repeated; columns with the names of the new ones are replaced.
    """
    tables, machine = model
    spark = docs.sparkSession
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new and (c != text or carry is not None)]
    sent = spark.sparkContext.broadcast(machine)
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("carried") if names else F.struct(F.lit(0).alias("c0")).alias("carried"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    fields = T.StructType([rows.schema["carried"], T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("head_known", T.LongType()), T.StructField("head_base", T.DoubleType()), T.StructField("head_score", T.DoubleType()), *[T.StructField(c, T.BinaryType()) for c in CODED]])

    def run(batches):
        m: Automaton = sent.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, first = token_hashes(piece.column(piece.schema.get_field_index("text")))
                w = m.ids.of(h)
                rare = w < 0
                base = np.concatenate([[0.0], np.cumsum(np.where(rare, 0.0, m.word[w]))]) if len(m.word) else np.zeros(len(w) + 1)
                known = np.concatenate([[0], np.cumsum(~rare)])
                scores = traverse(m, w, first)
                known = known[first[1:]] - known[first[:-1]]
                unseen = m.unseen * (np.diff(first) - known)  # until the rare ones among them meet their counts
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(np.diff(first)), pa.array(known), pa.array(base[first[1:]] - base[first[:-1]] + unseen), pa.array(scores + unseen, pa.float64()), *m.coder.columns(h, w, first)],
                    names=fields.names,
                )
        trim()

    heads, _ = stored(rows.mapInArrow(run, fields), "lm-heads", {PLAIN: "false"})
    # rarer words meet their exact counts, and longer n-grams without an arc theirs; a few numbers for each text come back
    words = tables[1].where(F.col("c") < machine.least).select("h", F.lit(1).alias("tail_known"), (F.log10("p") - F.lit(machine.unseen)).alias("tail"), (F.col("s") - F.lit(machine.unseen)).alias("tail1"))
    asked = int(heads.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    out = heads.drop(*CODED)
    for n in range(1, max(machine.heads, default=1) + 1):
        table = words if n == 1 else tables[n].withColumnRenamed("s", f"tail{n}")
        out = out.join(stored(_tails(heads, table, n, machine, asked), f"lm-tails{n}")[0], "row", "left")
        release(spark)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        *[F.col(f"carried.c{k}").alias(c) for k, c in enumerate(names)],
        "n_tokens",
        (F.col("head_known") + zero("tail_known").cast("long")).alias("n_known"),
        F.lit(machine.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("tail")).alias("base_score"),
        sum((zero(f"tail{n}") for n in (1, *machine.heads)), F.col("head_score")).alias("score"),
    )


def split(id_column: Column, n: int = 10) -> Column:
    """Remainder of crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n
