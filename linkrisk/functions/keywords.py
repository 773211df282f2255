"""Many keywords at once: an Aho-Corasick automaton in arrays, run over whole Arrow batches.

A pack with few keywords is scored by native ``contains`` expressions; one test
for each keyword and row does not go on for thousands of them.  Here a text's
bytes are read once, whatever the number of keywords.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import Rules, RulesError

#: Keywords up to which native expressions are used.
FEW = 300
#: Bytes of one automaton's transitions; a larger pack is cut into several, and those may take so much in all.
BLOCK_BYTES, MOST_BYTES = 64 << 20, 1 << 30
#: Bytes of a text that a lane reads (and as many more as the longest keyword has); lanes step together.
LANE = 512

BEST = "struct<a:int,c:int,order:int,category:string,label:string,found:array<string>>"


class Automaton:
    """Where in texts distinct words stand.

    step: for each state and byte class the next state.  A word ends in a state
    if it is the state's own or that of a state on its chain of ``shorter`` ones.
    """

    def __init__(self, words: Sequence[bytes]):
        self.size, self.longest = len(words), max(map(len, words), default=0)
        used = sorted(set(b"".join(words)))
        self.kind = np.zeros(256, np.int64)
        self.kind[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for i, word in enumerate(words):
            at = 0
            for b in self.kind[np.frombuffer(word, np.uint8)].tolist():
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    own.append(-1)
                at = children[at][b]
            own[at] = i
        self.own = np.array(own, np.int64)
        self.step = np.zeros((len(children), len(used) + 1), np.int32)
        self.shorter = np.zeros(len(children), np.int64)
        fail = np.zeros(len(children), np.int64)
        turn = [0]
        for at in turn:  # breadth first: what a state falls back to is done before it
            back = int(fail[at])
            if at:
                self.step[at] = self.step[back]
                self.shorter[at] = back if own[back] >= 0 else self.shorter[back]
            for b, to in children[at].items():
                fail[to] = self.step[back, b] if at else 0
                self.step[at, b] = to
                turn.append(to)
        self.ends = (self.own >= 0) | (self.shorter > 0)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) of every word that stands in a text, each once, in order."""
        length = np.diff(offsets)
        lanes = -(-length // LANE)
        row = np.repeat(np.arange(len(length)), lanes)
        begin = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        size = np.minimum(LANE + self.longest - 1, offsets[row + 1] - begin)
        order = np.argsort(-size, kind="stable")
        row, begin, size = row[order], begin[order], size[order]
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # lanes longer than t
        kinds = self.kind[data]
        state = np.zeros(len(row), np.int64)
        rows, states = [], []
        for t, n in enumerate(active.tolist()):
            state[:n] = self.step[state[:n], kinds[begin[:n] + t]]
            hit = np.flatnonzero(self.ends[state[:n]])
            rows.append(row[hit])
            states.append(state[hit])
        row, state = (np.concatenate([np.empty(0, np.int64), *x]) for x in (rows, states))
        found = []
        while len(row):
            here = self.own[state] >= 0
            found.append(row[here] * self.size + self.own[state[here]])
            row, state = row[self.shorter[state] > 0], self.shorter[state][self.shorter[state] > 0]
        codes = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
        return codes // max(1, self.size), codes % max(1, self.size)


def blocks_of(words: Sequence[str]) -> list[tuple[int, Automaton]]:
    """Automata for runs of the words, each with the number of its first word."""
    classes = len(set("".join(words).encode())) + 1
    most = max(1, BLOCK_BYTES // (4 * classes))
    made, run, states, first = [], [], 0, 0
    total = sum(len(w.encode()) for w in words) * classes * 4
    if total > MOST_BYTES:
        raise RulesError(f"keywords of {len(words)} words take {total} bytes; at most {MOST_BYTES} are sent out")
    for i, word in enumerate(words):
        raw = word.encode()
        if run and states + len(raw) > most:
            made.append((first, Automaton(run)))
            run, states, first = [], 0, i
        run.append(raw)
        states += len(raw)
    return [*made, (first, Automaton(run))] if run else made


class Pack:
    """A rule pack's keywords by automaton: the same result as one test for each."""

    def __init__(self, categories: tuple):
        self.names, self.labels = [c for c, *_ in categories], [label for _, label, _ in categories]
        listed = [(i, k, w) for i, (*_, keywords) in enumerate(categories) for k, w in keywords if w > 0]
        words = list(dict.fromkeys(k for _, k, _ in listed))
        number = {w: i for i, w in enumerate(words)}
        self.blocks, self.size = blocks_of(words), len(words)
        # (category, keyword) pairs by word; a word may count in several categories
        of = np.array([number[k] for _, k, _ in listed], np.int64)
        by_word = np.argsort(of, kind="stable")
        self.first = np.searchsorted(of[by_word], np.arange(len(words) + 1))
        self.pair = by_word
        self.category = np.array([i for i, *_ in listed], np.int64)
        self.weight = np.array([w for *_, w in listed], np.int64)
        self.keyword = pa.array([k for _, k, _ in listed], pa.string())

    def find(self, column) -> np.ndarray:
        """text * size + word of all words in texts, in order."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        _, offs, raw = column.buffers()
        offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
        found = [np.empty(0, np.int64)]
        for first, automaton in self.blocks:
            row, word = automaton.find(data, offsets - offsets[0])
            found.append(row * self.size + first + word)
        return np.sort(np.concatenate(found))

    def pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, pair) for each category that a found word counts in."""
        row, word = codes // max(1, self.size), codes % max(1, self.size)
        n = self.first[word + 1] - self.first[word]
        at = np.repeat(self.first[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(row, n), self.pair[at]

    def best(self, anchor, around) -> pa.Array:
        """The category of each link: most in the anchor, then in the rest, then first in the pack."""
        rows, kinds = len(anchor), max(1, len(self.names))
        here = self.find(anchor)
        there = np.setdiff1d(self.find(around), here, assume_unique=True)
        sides = [self.pairs(x) for x in (here, there)]
        sums = [np.bincount(r * kinds + self.category[p], self.weight[p], rows * kinds).reshape(rows, kinds).astype(np.int64) for r, p in sides]
        a, c = sums
        winner = np.argmax(a * (int(c.max(initial=0)) + 1) + c, axis=1) if rows else np.empty(0, np.int64)  # the first of equals
        every = np.arange(rows)
        row = np.concatenate([r for r, _ in sides])
        pair = np.concatenate([p for _, p in sides])
        side = np.repeat([0, 1], [len(p) for _, p in sides])
        own = self.category[pair] == winner[row]
        order = np.lexsort((pair[own], side[own], row[own]))
        edges = np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=rows))]).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(edges), self.keyword.take(pa.array(pair[own][order])))
        columns = [pa.array(x.astype(np.int32)) for x in (a[every, winner], c[every, winner], -winner)]
        columns += [pa.array(x, pa.string()).take(pa.array(winner)) for x in (self.names, self.labels)]
        return pa.StructArray.from_arrays([*columns, found], names=["a", "c", "order", "category", "label", "found"])


@lru_cache(maxsize=8)
def _pack(categories: tuple) -> Pack:
    return Pack(categories)


def many(rules: Rules) -> bool:
    """Whether a pack has more keywords than native expressions are good for."""
    return sum(len(keywords) for *_, keywords in rules.categories) > max(0, FEW)


def best_category(df: DataFrame, anchor: Column, around: Column, rules: Rules) -> Column:
    """The struct of :class:`Pack.best` for lower-case texts; the automata go to each executor once."""
    sent = df.sparkSession.sparkContext.broadcast(_pack(rules.categories))

    @F.arrow_udf(BEST)
    def best(a: pa.Array, b: pa.Array) -> pa.Array:
        return sent.value.best(a, b)

    return best(anchor, around)


def pair_count(text: Column, rules: Rules) -> Column:
    """How many (category, keyword) pairs of positive weight or not a lower-case text has."""
    from pyspark.sql import SparkSession

    # weights do not matter here
    every = tuple((c, label, tuple((k, 1) for k, _ in keywords)) for c, label, keywords in rules.categories)
    sent = SparkSession.active().sparkContext.broadcast(_pack(every))

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        pack = sent.value
        return pa.array(np.bincount(pack.pairs(pack.find(texts))[0], minlength=len(texts)).astype(np.int32))

    return count(text)
