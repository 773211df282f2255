"""SimHash near-dedup: a binary trie of fingerprints joined with itself.

Fingerprints are made once for each document; documents that cannot be told
apart are one leaf.  Leaves are dealt out in blocks, such that two that link meet
in one block at least; in a block the trie is joined with itself: node pairs are
walked together, differing bits add up, and a pair over the error budget is
pruned.  A block hands on a spanning forest of its links, not all pairs, and
rounds of large-star/small-star joins put the forests of all blocks together.

Two plans.  A budget of a few bits (:class:`Plan`) deals leaves out by the first
bits of rearranged fingerprints, which is complete by the pigeonhole principle.
A similarity of shingle sets (:class:`Similar`) means a seventh of all bits,
where first bits no longer tell pairs from non-pairs; there a block is the
leaves that share a least shingle under one of several orders, and the pairs
that the trie finds are compared shingle by shingle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import KEY, LOWER, NON_SPACE, PIECE, U64, Words, buffers, cut, extended, mix, pieces, release, row_key, trim, window_hashes

#: Node pairs that are walked at a time; leaf pairs that are compared at a time.
FRONTIER = 1 << 17
#: Node pairs with at most so many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 64
#: Leaves of a block that are aimed at: a strict plan's first bits are as many as that takes.
BLOCK = 1 << 16
#: Leaves of a block by similarity; a block of more is split. Bytes of leaves that are worked on together.
HOT, HELD = 4096, 16 << 20
#: Pairs whose sets are compared before components are looked at again.
COMPARED = 256


@dataclass(frozen=True)
class Plan:
    """Links at ``budget`` differing bits or fewer of 64, on shingles of ``shingle`` words, repeats included."""

    shingle: int = 4
    budget: int = 4

    leaf = ("fp0",)
    more = ()

    def views(self, leaves: int) -> list[list[tuple[int, int]]]:
        """For each view the parts (lowest bit, width) that must be equal, then the others.

        Of ``budget`` + e parts, a pair within the budget has e equal; e is as
        large as it takes for blocks of about :data:`BLOCK` leaves.
        """
        e = 1
        while leaves >> (64 * e // (self.budget + e)) > BLOCK and comb(self.budget + e, e) < 500:
            e += 1
        n = self.budget + e
        edges = [64 * i // n for i in range(n + 1)]
        parts = [(a, b - a) for a, b in zip(edges, edges[1:])]
        return [[*(parts[i] for i in chosen), *(p for i, p in enumerate(parts) if i not in chosen)] for chosen in combinations(range(n), e)]

    def head(self, leaves: int) -> int:
        return len(self.views(leaves)[0]) - self.budget


@dataclass(frozen=True)
class Similar:
    """Links at a Jaccard ``similarity`` or more of the sets of ``shingle``-word shingles.

    Fingerprints have ``words`` x 64 bits; ``orders``: least shingles that are looked at;
    ``levels``: how often a block of many leaves is split by as many further orders.
    """

    shingle: int = 5
    similarity: float = 0.8
    words: int = 4
    orders: int = 4
    levels: int = 2

    @property
    def leaf(self) -> tuple[str, ...]:
        return ("s0", "s1", "n")

    @property
    def more(self) -> tuple[str, ...]:
        return (*[f"fp{w}" for w in range(self.words)], *[f"m{v}" for v in range(self.orders * (self.levels + 1))])

    def allowed(self) -> np.ndarray:
        """Differing bits that a pair may have within its first 0, 1, 2, ... bits: the mean at the similarity and five deviations."""
        p = acos(2 * self.similarity / (1 + self.similarity)) / pi
        depth = np.arange(self.words * 64 + 1)
        return np.ceil(depth * p + 5 * np.sqrt(depth * p * (1 - p))).astype(np.int64)


#: Links at 4 bits or fewer of 64, on 4-word shingles; complete.
STRICT = Plan()
#: Links at a similarity of 0.8 or more of 5-word shingles.
SIMILAR = Similar()

_SEPARATOR = 32


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each of the 64 bits."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _strict_maker(plan: Plan):
    import xxhash

    digest, k = xxhash.xxh64_intdigest, plan.shingle
    step = 1 << 15

    def one(raw: bytes) -> int:
        flat = b" ".join(raw.lower().split())
        if not flat:
            return 0
        spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == _SEPARATOR)
        starts = np.concatenate([[0], spaces + 1])
        ends = np.append(spaces, len(flat))
        n = max(1, len(starts) - k + 1)
        firsts, lasts = starts[:n].tolist(), (ends[k - 1 :] if len(ends) >= k else ends[-1:]).tolist()
        ones = np.zeros(64, np.int64)
        for a in range(0, n, step):
            h = np.array([digest(flat[s:e], 42) for s, e in zip(firsts[a : a + step], lasts[a : a + step])], U64)
            ones += _ones(h)
        return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])

    def run(column):
        data, offsets = buffers(column)
        blob, edges = data.tobytes(), offsets.tolist()
        return [pa.array([one(blob[a:b]) for a, b in zip(edges, edges[1:])], pa.int64())]

    return run



def shingle_sets(column, k: int):
    """For each text the sorted distinct hashes of its shingles.

    A-Z is lower-cased.  A text of fewer words than a shingle is one shingle; one
    without words has none.
    """
    words = Words(column, NON_SPACE, LOWER)
    h = words.hashes()
    windows = window_hashes(h, k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        yield np.unique(windows[a : b - k + 1]) if b - a >= k else window_hashes(h[a:b], b - a) if b > a else np.empty(0, U64)


def _salts(n: int, first: int) -> np.ndarray:
    return mix(np.arange(first, first + n, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _similar_maker(plan: Similar):
    bits, orders = _salts(plan.words, 1), _salts(plan.orders * (plan.levels + 1), 100)[:, None]
    columns = [*plan.leaf, *plan.more]

    def run(column):
        out = np.zeros((len(columns), len(column)), np.int64)
        for r, u in enumerate(shingle_sets(column, plan.shingle)):
            n = len(u)
            if not n:
                continue
            prints = [np.packbits(2 * _ones(mix(u ^ b)) > n, bitorder="little").view("<i8")[0] for b in bits]
            least = mix(u[None, :] ^ orders).min(axis=1).view(np.int64)
            out[:, r] = [*np.array([u.sum(), mix(u).sum()]).view(np.int64), n, *prints, *least]
        return [pa.array(x) for x in out]

    return run


def fingerprints(docs: DataFrame, plan: Plan | Similar = STRICT, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns that the plan compares (all longs).

    A strict plan gives ``fp0``, the fingerprint.  A plan by similarity gives s0,
    s1 and n, which name the set of shingles, the fingerprint's words fp0, fp1,
    ..., and the least shingle of each order, m0, m1, ...  A-Z is lower-cased;
    words are runs of anything but ASCII white space.  A text of fewer words than
    a shingle is one shingle; null and texts without words have zeros.
    """
    fields = [T.StructField(c, T.LongType()) for c in (*plan.leaf, *plan.more)]
    return extended(docs, text, fields, lambda: (_strict_maker if isinstance(plan, Plan) else _similar_maker)(plan), carry, limit=PIECE // 2)


def _walk(keys: list[np.ndarray], group_edges: np.ndarray, top: int, allowed: np.ndarray):
    """Pairs of positions whose keys differ in at most allowed[d] of the bits from ``top`` to d, at each depth d.

    keys: 64-bit words, the first the highest; sorted within each group [edge,
    next edge).  Works level by level on arrays of node pairs; a long frontier
    is split and walked in parts.
    """
    bits = 64 * len(keys)

    def below(depth):  # number of keys before each position that have the bit of this depth
        total = np.zeros(len(keys[0]) + 1, np.int32)
        np.cumsum((keys[depth // 64] >> U64(63 - depth % 64)) & U64(1), out=total[1:], dtype=np.int32)
        return total

    lo, hi = group_edges[:-1], group_edges[1:]
    full = hi - lo > 1
    stack = [(top, np.stack([lo[full], hi[full], lo[full], hi[full], np.zeros(full.sum(), np.int64)]))]
    while stack:
        depth, nodes = stack.pop()
        if nodes.shape[1] > FRONTIER:
            half = nodes.shape[1] // 2
            stack += [(depth, nodes[:, :half]), (depth, nodes[:, half:])]
            continue
        small = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= LEAF_PAIRS
        if depth == bits:
            small[:] = True
        if small.any():
            yield from _leaves(nodes[:, small])
            nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        c = below(depth)
        a, b, x, y, err = nodes
        m, n = b - (c[b] - c[a]), y - (c[y] - c[x])
        own = (a == x) & (b == y)
        made = [
            np.stack([a, m, x, n, err]),
            np.stack([m, b, n, y, err]),
            np.stack([a, m, n, y, err + 1]),
            np.stack([m, b, x, n, err + 1])[:, ~own],
        ]
        made = np.concatenate(made, axis=1)
        stack.append((depth + 1, made[:, (made[0] < made[1]) & (made[2] < made[3]) & (made[4] <= allowed[depth + 1])]))


def _leaves(nodes: np.ndarray):
    """Position pairs of small node pairs, in parts."""
    sizes = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + 4 * FRONTIER, "right")))
        part, n = nodes[:, at:to], sizes[at:to]
        which = np.repeat(np.arange(to - at), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = (part[3] - part[2])[which]
        i, j = part[0][which] + inside // width, part[2][which] + inside % width
        keep = (i < j) | (part[0] != part[2])[which]
        yield i[keep], j[keep]
        at = to


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of linked positions; a label is its component's smallest position."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def _differing(words: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words)


def _children(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """(leaf, root) of every leaf that has a smaller one in its component."""
    child = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[label[child]])], names=["a", "b"])


def _strict_forest(plan: Plan, top: list[int], table: pa.Table) -> pa.RecordBatch:
    """A spanning forest of the links in whole (view, head) groups."""
    view, key = table.column("view").to_numpy(), table.column("key").to_numpy().view(U64)
    new = np.flatnonzero(np.r_[True, (np.diff(view) != 0) | (np.diff(table.column("head").to_numpy()) != 0)])
    label = np.arange(len(key))
    allowed = np.full(65, plan.budget)
    for equal in np.unique(view):
        of = np.flatnonzero(view[new] == equal)
        edges = np.append(new[of], (np.append(new, len(key)))[of[-1] + 1])
        for i, j in _walk([key], edges, top[equal], allowed):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            for a in range(0, len(i), FRONTIER):
                p, q = i[a : a + FRONTIER], j[a : a + FRONTIER]
                near = _differing([key], p, q) <= plan.budget
                _hook(label, p[near], q[near])
    return _children(table.column("leaf").to_numpy(), label)


def _similar_forest(plan: Similar, table: pa.Table) -> pa.RecordBatch:
    """A spanning forest of the links in whole blocks: the trie finds pairs, their sets decide."""
    block = table.column("block").to_numpy()
    prints = [table.column(f"fp{w}").to_numpy().view(U64) for w in range(plan.words)]
    order = np.lexsort([*prints[::-1], block])
    block, prints = block[order], [x[order] for x in prints]
    sets = table.column("shingles").combine_chunks()
    sets = pa.concat_arrays(sets.chunks) if isinstance(sets, pa.ChunkedArray) else sets
    flat = np.frombuffer(sets.buffers()[2], np.uint8)
    bounds = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1]
    own = [flat[bounds[k] : bounds[k + 1]].view("<u4") for k in order.tolist()]
    size = np.array([len(x) for x in own], np.int64)
    edges = np.append(np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block))
    label = np.arange(len(block))
    allowed, least = plan.allowed(), plan.similarity

    def similar(p: int, q: int) -> bool:
        both = np.concatenate((own[p], own[q]))
        both.sort()
        shared = np.count_nonzero(both[1:] == both[:-1])
        return shared >= least * (len(both) - shared)

    for i, j in _walk(prints, edges, 0, allowed):
        # linked ones need no second link, and sets of too different size can't be that similar
        open_ = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]))
        i, j = i[open_], j[open_]
        away = _differing(prints, i, j)
        near = away <= allowed[-1]
        nearest = np.argsort(away[near], kind="stable")
        i, j = i[near][nearest], j[near][nearest]
        at = 0
        while at < len(i):
            p, q = i[at : at + COMPARED], j[at : at + COMPARED]
            linked = np.array([similar(x, y) for x, y in zip(p.tolist(), q.tolist())], bool)
            at += COMPARED
            if linked.any():
                _hook(label, p[linked], q[linked])
                apart = label[i[at:]] != label[j[at:]]
                i, j, at = i[at:][apart], j[at:][apart], 0
    return _children(table.column("leaf").to_numpy()[order], label)


def _by_group(make, columns: list[str], limit: int):
    """A function for mapInArrow: whole runs of rows that are equal in ``columns``, about ``limit`` bytes of them at a time."""

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = pa.Table.from_batches([batch.slice(at, 4096)])
                held.append(part)
                size += part.nbytes
                if size < limit:
                    continue
                table = pa.concat_tables(held).combine_chunks()
                changed = np.zeros(max(0, table.num_rows - 1), bool)
                for c in columns:
                    changed |= np.diff(table.column(c).to_numpy()) != 0
                breaks = np.flatnonzero(changed)
                if len(breaks):  # the last group may go on
                    whole = int(breaks[-1]) + 1
                    yield make(table.slice(0, whole).combine_chunks())
                    table = table.slice(whole).combine_chunks()
                held, size = [table], 0 if len(breaks) else -table.nbytes
        table = pa.concat_tables(held).combine_chunks() if held else None
        if table is not None and table.num_rows:
            yield make(table)
        trim()

    return run


def strict_links(leaves: DataFrame, plan: Plan) -> DataFrame:
    """(a, b) leaf numbers: a spanning forest of the links of every block, over all views.

    leaves: leaf (a unique long) and fp0.
    """
    count = leaves.count()
    views, head = plan.views(count), plan.head(count)
    top = [sum(w for _, w in parts[:head]) for parts in views]
    made = []
    for v, parts in enumerate(views):
        turned, place = None, 64
        for low, width in parts:
            place -= width
            bits = F.shiftleft(F.shiftrightunsigned("fp0", low).bitwiseAND(F.lit((1 << width) - 1)), place)
            turned = bits if turned is None else turned.bitwiseOR(bits)
        made.append(F.struct(F.lit(v).alias("view"), turned.alias("key"), F.shiftrightunsigned(turned, 64 - top[v]).alias("head")))
    rows = leaves.select("leaf", F.explode(F.array(*made)).alias("v")).select("leaf", "v.view", "v.key", "v.head")
    # unsigned order of the keys: the sign bit turned
    rows = rows.repartition("view", "head").sortWithinPartitions("view", "head", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    return rows.mapInArrow(_by_group(lambda table: _strict_forest(plan, top, table), ["view", "head"], HELD // 8), "a long, b long").distinct()


def _cells(rows: DataFrame) -> DataFrame:
    """(leaf, block): each block of ``rows`` (leaf, block, leaves) as cells of some :data:`HOT` leaves, any two leaves together in one.

    Leaves are dealt into parts by a hash of their number, and a cell is two parts.
    """
    parts = F.ceil(F.col("leaves") * 2 / HOT).cast("int")
    dealt = rows.select("leaf", "block", F.pmod(F.xxhash64("leaf"), parts).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    return dealt.where("own != other").select("leaf", F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("block"))


def _blocks(leaves: DataFrame, plan: Similar) -> DataFrame:
    """(leaf, block): blocks of two leaves to some :data:`HOT`, such that similar leaves meet in one.

    A block is the leaves of one least shingle.  One that is too large is split
    by further orders, where a pair must share one least shingle again; if one
    of the parts keeps more than half of the leaves, they are much alike and no
    order parts them, so the block goes into cells that lose no pair, and so does
    what is still too large after the last level.
    """
    least = lambda level: F.posexplode(F.array(*[F.col(f"m{v}") for v in range(level * plan.orders, (level + 1) * plan.orders)])).alias("view", "key")
    rows = leaves.where("n > 0").select("leaf", least(0)).select("leaf", F.xxhash64("view", "key").alias("block"))
    made = []
    for level in range(1, plan.levels + 2):
        sizes = cut(rows.groupBy("block").agg(F.count(F.lit(1)).alias("leaves")).where("leaves > 1"))
        made.append(rows.join(sizes.where(F.col("leaves") <= HOT), "block").select("leaf", "block"))
        hot = sizes.where(F.col("leaves") > HOT)
        if hot.isEmpty():
            break
        large = rows.join(hot, "block").select("leaf", "block", "leaves")
        if level > plan.levels:
            made.append(_cells(large))
            break
        parts = cut(large.join(leaves, "leaf").select("leaf", "block", "leaves", least(level)))
        largest = parts.groupBy("block", "view", "key").agg(F.count(F.lit(1)).alias("n"), F.first("leaves").alias("leaves")).groupBy("block").agg(F.max(F.col("n") * 2 > F.col("leaves")).alias("alike"))
        alike = cut(largest.where("alike").select("block"))
        made.append(_cells(large.join(alike, "block")))
        rows = parts.join(alike, "block", "left_anti").select("leaf", F.xxhash64("block", "view", "key").alias("block"))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def similar_links(leaves: DataFrame, texts: DataFrame, plan: Similar) -> DataFrame:
    """(a, b) leaf numbers: a spanning forest of the links of every block.

    leaves: leaf, first (the key of a row that has the set), n, the fingerprint
    and the least shingles; texts: KEY and text.  A pair at the similarity shares
    each least shingle with that probability, so it is missed with
    (1 - similarity) ** orders at most, and once more for each level at which its
    blocks are too large and split, however many leaves there are.
    """
    members = _blocks(leaves, plan)
    blocks = members.groupBy("leaf").agg(F.collect_list("block").alias("blocks"))
    wanted = blocks.join(leaves, "leaf").select("first.*", "leaf", "blocks", *[f"fp{w}" for w in range(plan.words)])
    rows = texts.join(wanted, KEY).select("text", "leaf", "blocks", *[f"fp{w}" for w in range(plan.words)])
    names = ["leaf", "block", *[f"fp{w}" for w in range(plan.words)], "shingles"]

    def deal(batches):
        last = None
        for batch in batches:
            for piece in pieces(batch, "text", PIECE // 2):
                leaf = piece.column(1).to_numpy()
                made = [(u >> U64(32)).astype("<u4") for u in shingle_sets(piece.column(0), plan.shingle)]
                # of rows repeated with id and text, which stand together, one is enough
                fresh = np.diff(leaf, prepend=leaf[0] - 1 if last is None else last) != 0
                last = int(leaf[-1])
                times = piece.column(2).value_lengths().to_numpy() * fresh
                take = np.repeat(np.arange(len(leaf)), times)
                kept = piece.column(2).filter(pa.array(fresh)).flatten()
                sets = pa.array([made[k].tobytes() for k in take.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(leaf[take]), kept, *[piece.column(3 + w).take(pa.array(take)) for w in range(plan.words)], sets], names=names)
        trim()

    dealt = rows.mapInArrow(deal, ", ".join(f"{c} long" for c in names[:-1]) + ", shingles binary")
    together = dealt.repartition("block").sortWithinPartitions("block")
    return together.mapInArrow(_by_group(lambda table: _similar_forest(plan, table), ["block"], HELD), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that is not its own root.

    Rounds of large-star and small-star, each a minimum per node and a join;
    lineage is cut after each round and only a count and a sum come back.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e: a > b.  Large: over all neighbours, larger ones move to the least; small: smaller ones move.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.join(least, "a")
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a > b").distinct()

    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    was = state(now)
    while was[0]:
        now = cut(star(star(now, True), False))
        if (fresh := state(now)) == was:
            break
        was = fresh
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, plan: Plan | Similar = STRICT, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each row's leaf columns (fp0, or s0, s1 and n), component_id (the smallest id in its group) and keeper.

    keeper names the row that stays for the group: null id last, then smallest
    id, then least hash of its text (:func:`row_key`).  A null id is in its
    group like any other but never names it unless the whole group has none.
    Null, empty and blank texts are one group.  Empty tables give no rows;
    repeated rows are in one group.  Other columns are left out.
    """
    base = docs.select(*row_key(docs, id_col, text), F.col(f"`{id_col}`").alias("own"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    prints = cut(fingerprints(base, plan, carry=[*KEY, "own"]))
    leaf = list(plan.leaf)
    named = prints.groupBy(*leaf).agg(F.min(F.struct(*KEY)).alias("first"), *[F.first(c).alias(c) for c in plan.more])
    if isinstance(plan, Plan):
        leaves = named.withColumn("leaf", F.col("fp0"))
        edges = strict_links(leaves, plan)
    else:
        leaves = cut(named.withColumn("leaf", F.monotonically_increasing_id()))
        edges = similar_links(leaves, base.select(*KEY, "text"), plan)
    roots = components(edges)
    release(docs.sparkSession)
    placed = leaves.join(roots, leaves["leaf"] == roots["node"], "left").select(*leaf, "first", F.coalesce("root", "leaf").alias("component"))
    # only components of two leaves or more need a minimum over them
    several = placed.join(roots.select(F.col("root").alias("component")).distinct(), "component", "left_semi").groupBy("component").agg(F.min("first").alias("least"))
    # a table of its own, so that a common leaf can be split in the join
    keepers = cut(placed.join(several, "component", "left").select(*leaf, F.coalesce("least", "first").alias("keeper")))
    out = prints.join(keepers, leaf)
    return out.select(F.col("own").alias(id_col), *leaf, F.when(~F.col("keeper.none"), F.col("keeper.id")).cast(docs.schema[id_col].dataType).alias("component_id"), "keeper")


def deduplicated(docs: DataFrame, plan: Plan | Similar = SIMILAR, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each near-duplicate group; columns as before.

    The group's keeper stays; of rows repeated with its id and text, one.
    """
    names = docs.columns
    stays = cut(near_groups(docs, plan, text=text, id_col=id_col).select("keeper.*").distinct())
    release(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *row_key(docs, id_col, text))
    kept = rows.join(stays, KEY, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0))))
    return kept.where("copy = 1").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
