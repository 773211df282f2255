"""Benchmark decontamination by suffix arrays.

Every piece of training text (a shard) gets a suffix array over its words; the
suffixes of all benchmark items are binary-searched in it.  A suffix range holds
all places where a window of an item stands; the ranks of items and texts in one
order give the longest verbatim match from each.  Documents never leave their task, so
there is no shuffle; only the benchmark is sent out, in blocks of bounded size
that a task takes one after another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import ALNUM, LOWER, PIECE, Lookup, Words, extended, same_spans, trim, word_ids

#: UTF-8 bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are searched for one block after another.
MOST_TEXT = 16 << 20

SPAN = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("longest", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(SPAN)),
    T.StructField("contaminated", T.BooleanType()),
]


def run_ids(tokens: np.ndarray, n: int) -> np.ndarray:
    """A number for the run of n tokens from each place on, equal for equal runs (nonsense where fewer follow)."""
    run, width, out, taken = np.unique(tokens, return_inverse=True)[1], 1, np.zeros(len(tokens), np.int64), 0
    shifted = lambda x, d: np.concatenate([x[d:], np.zeros(min(d, len(x)), np.int64)])[: len(x)]
    joined = lambda x, y: np.unique(x * (int(y.max(initial=0)) + 1) + y, return_inverse=True)[1]
    while n:
        if n & 1:
            out = joined(out, shifted(run, taken))
            taken += width
        n >>= 1
        run = joined(run, shifted(run, width)) if n else run
        width *= 2
    return out


class Index:
    """One block of benchmark items: their words as numbers and their distinct windows.

    Words are told apart by their bytes; a hash only says where to look.  A
    window that items share, or that one item repeats, is looked up once.
    """

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        words = Words(texts, ALNUM, LOWER)
        self.ids, self.window = ids, window
        numbers = word_ids(words)
        _, first = np.unique(numbers, return_index=True)
        hashes = words.hashes()[first]
        by_hash = np.argsort(hashes, kind="stable")
        self.lookup, self.number = Lookup(hashes[by_hash]), by_hash
        self.data, self.start, self.size = words.data, words.start[first][by_hash], (words.end - words.start)[first][by_hash]
        counts, row = words.counts, words.row_of()
        # items stand one after another, parted by 0
        self.tokens = np.zeros(len(words) + len(ids) + window, np.int64)
        at = np.arange(len(words)) + row
        self.tokens[at] = numbers + 1
        own = np.arange(len(words)) - words.first[:-1][row]
        length = counts[row]
        looked_up = (own + window <= length) | ((length < window) & (own == 0))
        at, item, length = at[looked_up], row[looked_up], np.minimum(length[looked_up], window)
        suffix, sizes, pairs = [], [], []
        for n in np.unique(length).tolist():
            some = np.flatnonzero(length == n)
            _, one, which = np.unique(run_ids(self.tokens, n)[at[some]], return_index=True, return_inverse=True)
            pairs.append(np.stack([which + sum(map(len, suffix)), item[some]]))
            suffix.append(at[some][one])
            sizes.append(np.full(len(one), n))
        none = np.empty(0, np.int64)
        self.suffix, self.length = np.concatenate([none, *suffix]), np.concatenate([none, *sizes])
        # the items of each distinct window, each once
        held = np.unique(np.concatenate([np.empty((2, 0), np.int64), *pairs], axis=1), axis=1)
        self.first, self.items = np.searchsorted(held[0], np.arange(len(self.suffix) + 1)), held[1]
        self.begin = np.concatenate([[0], np.cumsum(counts + 1)])  # of each item in tokens
        self.shortest = int(self.length.min()) if len(self.length) else window

    def words_of(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 where no item has it."""
        at = self.lookup.of(hashes)
        open_ = np.flatnonzero(at >= 0)
        out = np.full(len(words), -1, np.int64)
        while len(open_):
            place, size = at[open_], (words.end - words.start)[open_]
            same = self.size[place] == size
            same[same] = same_spans(words.data, words.start[open_][same], self.data, self.start[place[same]], size[same])
            out[open_[same]] = self.number[place[same]]
            # another word of the same hash may follow
            open_, place = open_[~same], place[~same] + 1
            more = place < len(self.lookup.keys)
            more[more] = self.lookup.keys[place[more]] == hashes[open_[more]]
            open_ = open_[more]
            at[open_] = place[more]
        return out


def suffix_array(shard: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of all suffixes that begin with an item word, in order; a word that no item has (0) ends a suffix.

    Prefix doubling: a suffix's rank is where the suffixes that share its first d
    words begin in the array; those that share one are ranked anew by the rank of
    what follows these words, until all differ or have ended.
    left: how many item words stand from each place on.
    """
    order = np.flatnonzero(shard > 0)
    order = order[np.argsort(shard[order], kind="stable")]
    rank = np.zeros(len(shard), np.int64)

    def ranked(at, base, new):
        """Ranks of suffixes in order: base of the run, and how far into it the last new one stands."""
        place = np.arange(len(at))
        rank[at] = base + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(np.r_[True, base[1:] != base[:-1]], place, 0))

    if len(order):
        ranked(order, np.ones(len(order), np.int64), np.r_[True, shard[order[1:]] != shard[order[:-1]]])
    open_, depth = np.arange(len(order)), 1
    while len(open_):
        of = rank[order[open_]]
        again = np.r_[False, of[1:] == of[:-1]]
        open_ = open_[again | np.r_[again[1:], False]]
        at = order[open_]
        if not (left[at] > depth).any():
            break
        goes_on = left[at] > depth
        follow = np.zeros(len(at), np.int64)
        follow[goes_on] = rank[at[goes_on] + depth]
        by = np.lexsort((follow, rank[at]))
        at, follow = at[by], follow[by]
        order[open_], base = at, rank[at]
        ranked(at, base, np.r_[True, (base[1:] != base[:-1]) | (follow[1:] != follow[:-1])])
        depth *= 2
    return order


def _search(index: Index, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place in the shard, window and length of every occurrence of a distinct window, and the shard's word numbers.

    All windows are looked up at once: the range of the array that shares a
    window's first words is narrowed by binary search, word by word.  At most
    one window of each length begins at a place.
    """
    none = np.empty(0, np.int64)
    shard = np.zeros(len(words) + len(words.offsets) - 1 + index.window, np.int64)
    if not len(index.suffix) or not len(words):
        return none, none, none, shard
    found = index.words_of(words, hashes)
    shard[np.arange(len(words)) + words.row_of()] = found + 1
    ends = np.flatnonzero(shard == 0)
    left = ends[np.searchsorted(ends, np.arange(len(shard)))] - np.arange(len(shard))
    array = suffix_array(shard, left)
    array = array[left[array] >= index.shortest]  # the others end before the shortest window does
    if not len(array):
        return none, none, none, shard
    heads, first = shard[array], index.tokens[index.suffix]
    low, high = np.searchsorted(heads, first, "left"), np.searchsorted(heads, first, "right")
    for depth in range(1, index.window):
        on = np.flatnonzero((low < high) & (index.length > depth))
        if not len(on):
            break
        word = index.tokens[index.suffix[on] + depth]
        bounds = []
        for after in (False, True):
            a, b = low[on].copy(), high[on].copy()
            while (apart := a < b).any():
                middle = (a + b) // 2
                have = shard[array[np.minimum(middle, len(array) - 1)] + depth]
                below = (have <= word) if after else (have < word)
                a, b = np.where(apart & below, middle + 1, a), np.where(apart & ~below, middle, b)
            bounds.append(a)
        low[on], high[on] = bounds
    times = high - low
    which = np.repeat(np.arange(len(times)), times)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return array[low[which] + inside], which, index.length[which], shard


def longest_matches(items: list[np.ndarray], texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text and each of its places: the longest run of words from there that stands in an item, and one such item.

    Items and texts stand in one sequence, whose ranks by the first 1, 2, 4, ...
    words order all suffixes.  The item suffix next to a text's suffix, before or
    after it, shares most with it; how much, the ranks tell from the widest down.
    """
    every = [*items, *texts]
    size = np.array([len(x) + 1 for x in every])
    first = np.cumsum(size) - size
    sequence = np.concatenate([np.append(x, 0) for x in every])
    ends = np.flatnonzero(sequence == 0)
    sequence[ends] = int(sequence.max(initial=0)) + 1 + np.arange(len(ends))  # ends are all different
    ranks = [np.unique(sequence, return_inverse=True)[1]]
    width = 1
    while int(ranks[-1].max()) + 1 < len(sequence):
        follow = np.zeros(len(sequence), np.int64)
        follow[:-width] = ranks[-1][width:] + 1
        ranks.append(np.unique(ranks[-1] * (len(sequence) + 1) + follow, return_inverse=True)[1])
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    of_item = order < first[len(items)]
    place = np.arange(len(order))
    near = np.stack([np.maximum.accumulate(np.where(of_item, place, -1)), np.minimum.accumulate(np.where(of_item, place, len(order))[::-1])[::-1]])
    best, whose = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for side in near:
        own = np.flatnonzero(~of_item & (side >= 0) & (side < len(order)))
        p, q = order[own], order[side[own]]
        shared = np.zeros(len(own), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            a, b = np.minimum(p + shared, len(order) - 1), np.minimum(q + shared, len(order) - 1)
            shared += np.where(ranks[k][a] == ranks[k][b], 1 << k, 0)
        better = shared > best[p]
        best[p[better]], whose[p[better]] = shared[better], np.searchsorted(first, q[better], "right") - 1
    return [(best[a : a + n - 1], whose[a : a + n - 1]) for a, n in zip(first[len(items) :].tolist(), size[len(items) :].tolist())]


def _report(indexes, column) -> list[pa.Array]:
    words = Words(column, ALNUM, LOWER)
    rows, counts = len(column), words.counts
    hashes = words.hashes()
    row_at = np.append(words.first[:-1] + np.arange(rows), len(words) + rows)  # where a row begins in the shard
    delta = np.zeros(len(words) + rows + 2, np.int64)
    items: list[set] = [set() for _ in range(rows)]
    spans: dict[int, dict[int, tuple[int, str]]] = {}  # of each row, by place: words and item
    for get in indexes:
        index: Index = get()
        place, which, length, shard = _search(index, words, hashes)
        if not len(place):
            continue
        np.add.at(delta, place, 1)
        np.add.at(delta, place + length, -1)
        row = np.searchsorted(row_at, place, "right") - 1
        hit = np.unique(row * len(index.suffix) + which)
        hit_row, window = np.divmod(hit, len(index.suffix))
        n = index.first[window + 1] - index.first[window]
        found = index.items[np.repeat(index.first[window] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        for r, i in zip(np.repeat(hit_row, n).tolist(), found.tolist()):
            items[r].add(index.ids[i])
        some, used = np.unique(hit_row).tolist(), np.unique(found).tolist()
        at = longest_matches([index.tokens[index.begin[i] : index.begin[i + 1] - 1] for i in used], [shard[row_at[r] : row_at[r + 1] - 1] for r in some])
        begins = np.zeros(len(shard), bool)
        begins[place] = True
        for r, (longest, whose) in zip(some, at):
            into = spans.setdefault(r, {})
            for p in np.flatnonzero(begins[row_at[r] : row_at[r + 1] - 1]).tolist():
                into[p] = max(into.get(p, (0, "")), (int(longest[p]), index.ids[used[whose[p]]]))
    covered = (np.cumsum(delta[:-1]) > 0).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(covered)])
    hit = total[row_at[1:]] - total[row_at[:-1]]
    matches: list[list] = [[] for _ in range(rows)]
    for r, by_place in spans.items():
        reach = 0
        for p in sorted(by_place):  # those within a match that begins earlier are part of it
            n, i = by_place[p]
            if p + n > reach:
                matches[r].append({"item_id": i, "start": p, "words": n})
                reach = p + n
    return [
        pa.array(counts, pa.int64()),
        pa.array(hit, pa.int64()),
        pa.array([max((m["words"] for m in x), default=0) for x in matches], pa.int64()),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.array(matches, pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))),
        pa.array(hit > 0, pa.bool_()),
    ]


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with what each text shares verbatim with the benchmark.

    Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  An
    item's windows are its runs of ``window`` words; an item with fewer, but not
    none, is one window.  New columns: n_words, n_hit (words inside an
    occurrence), longest (longest match in words), items (ids as sorted
    strings; a null id counts as the string ``null``), matches (the longest
    verbatim match from each place where a window begins, without those inside
    an earlier one: one item that has it, first word, words), contaminated.  Null and empty texts have no words and no hits; a
    benchmark without words marks nothing; repeated items count once.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // (block_bytes // 2))) if size > block_bytes else 1
    sent = []
    for b in range(blocks):
        part = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)).toArrow()
        sent.append(spark.sparkContext.broadcast(Index(part.column("id").to_pylist(), part.column("text"), window)))
        del part
    trim()

    def make():
        def of(one):
            def get():
                value = one.value
                if len(sent) > 1:
                    one.__dict__.pop("_value", None)  # one block in memory at a time
                return value

            return get

        getters = [of(x) for x in sent]
        return lambda column: _report(getters, column)

    # with several blocks, each is fetched for more text at a time
    return extended(docs, text, FIELDS, make, carry, min(PIECE * blocks, MOST_TEXT))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **kw) -> DataFrame:
    """``docs`` without the documents in which a benchmark window stands; columns as before."""
    # under names of their own, so that no column of docs is replaced
    names = [f"c{k}" for k in range(len(docs.columns))]
    marked = mark_contaminated(docs.toDF(*names), benchmark, text=names[docs.columns.index(text)], carry=names, **kw)
    return marked.where(~F.col("contaminated")).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
