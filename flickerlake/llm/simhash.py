"""SimHash near-dedup: a distributed binary-trie self-join over 64-bit fingerprints.

Fingerprints are taken once for each document and made distinct. They are then held in six binary
tries, one for each choice of two of the four 16-bit blocks; a trie's upper 32 levels are the chosen
blocks and have an error budget of zero, its lower 32 levels have the budget of two. Two differing
bits touch two blocks at most, so any linked pair agrees on two blocks and meets in one trie. With no
budget above, a node at level 32 pairs with itself alone: its subtrie is joined in one task, and the
keys of 32 bits spread the tasks, which hold one subtrie or a CHUNK of small ones at a time. Within a
subtrie pairs of nodes are traversed together, level by level; a step to unlike children costs a bit,
and a pair is pruned when its bits exceed the budget. Only a spanning forest of the links found leaves
the task, never all pairs.

Components come from hash-to-minimum rounds over those forests (large star, small star), each written
to the shared folder.

Defined results: a null text has no words and the zero fingerprint, which links like any other; a
null doc_id is carried along and never names a component unless all of it is null; repeated rows and
ties share a component; a very long text is hashed in parts; an empty table gives no rows; other columns
are ignored. For deduplication at a stated similarity of shingles see ``neardup``, which builds on this.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_CLASS, UPPER, discard, keyed_join, materialize, pieces

SHINGLE = 3
BUDGET = 2
SEED = 42
BLOCKS, BLOCK_BITS = 4, 16
CHUNK = 1 << 16
FRONTIER = 1 << 18
_TO_LOWER = str.maketrans(UPPER, LOWER)
_space = re.compile(SPACE_CLASS)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is in over half of the shingles' hashes; a text is worked in parts."""
    total, counts, carried = 0, np.zeros(64, np.int64), []
    for part in pieces(text or ""):
        words = carried + [w for w in _space.split(part.translate(_TO_LOWER)) if w]
        if len(words) >= shingle:
            total += _count(words, shingle, counts)
            carried = words[len(words) - shingle + 1 :]
        else:
            carried = words
    if not total and carried:
        total = _count(carried, len(carried), counts)
    return int(sum(1 << i for i in range(64) if 2 * int(counts[i]) > total)) if total else 0


def _count(words: list[str], width: int, counts: np.ndarray) -> int:
    """Adds the bits of all shingles' hashes to ``counts``; their number."""
    import xxhash

    hashed, total = xxhash.xxh64_intdigest, len(words) - width + 1
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        hashes = np.fromiter((hashed(s, SEED) for s in map(" ".join, zip(*(part[k:] for k in range(width))))), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's bits as a signed long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(task, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Forest:
    """Union-find over the positions of one sorted array; keeps the smallest as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hooks larger roots to smaller ones until all pairs agree."""
        p = self.parent
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        p, r = self.parent, self.parent[x]
        while True:
            up = p[r]
            if (up == r).all():
                break
            r = up
        p[x] = r
        return r


def trie_join(keys: np.ndarray, low_bits: int, budget: int, found: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Self-join of the binary trie over sorted distinct ``keys``, from the nodes at level 64 - low_bits.

    A node is a range of the array. ``found`` gets positions of linked pairs, in bounded portions.
    The frontier of node pairs is worked depth first in slices of at most FRONTIER.
    """
    top = keys >> np.uint64(low_bits)
    first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(keys) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(keys)] if len(keys) else first
    several = last - first > 1
    first, last = first[several], last[several]
    stack = [(low_bits, first[i : i + FRONTIER], last[i : i + FRONTIER], first[i : i + FRONTIER], last[i : i + FRONTIER], np.zeros(len(first[i : i + FRONTIER]), np.int8)) for i in range(0, len(first), FRONTIER)]
    while stack:
        level, a0, a1, b0, b1, bits = stack.pop()
        # pairs of leaves are settled by one comparison of what is left of them
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            i, j, spent = a0[leaves], b0[leaves], bits[leaves]
            rest = (keys[i] ^ keys[j]) & np.uint64((1 << level) - 1)
            near = (i != j) & (spent + popcount(rest) <= budget)
            found(i[near], j[near])
            a0, a1, b0, b1, bits = (x[~leaves] for x in (a0, a1, b0, b1, bits))
        if not len(a0) or level == 0:
            if len(a0):
                raise AssertionError("keys must be distinct")
            continue
        level -= 1
        am, bm = _middle(keys, a0, a1, level), _middle(keys, b0, b1, level)
        same = a0 == b0
        parts = [
            (a0, am, b0, bm, bits),
            (am, a1, bm, b1, bits),
            (a0, am, bm, b1, bits + np.int8(1)),
            # of a node with itself, the mirrored pair of children is the same pair
            tuple(x[~same] for x in (am, a1, b0, bm, bits + np.int8(1))),
        ]
        nxt = [np.concatenate(x) for x in zip(*parts)]
        lone = (nxt[0] == nxt[2]) & (nxt[1] - nxt[0] <= 1)
        keep = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget) & ~lone
        nxt = [x[keep] for x in nxt]
        for i in range(0, len(nxt[0]), FRONTIER):
            stack.append((level, *(x[i : i + FRONTIER] for x in nxt)))


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where a node's keys begin to have ``bit`` set: a bisection of all nodes at once."""
    lo, hi, one = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while True:
        busy = np.flatnonzero(lo < hi)
        if not len(busy):
            return lo
        mid = (lo[busy] + hi[busy]) >> 1
        is_set = (keys[mid] & one) != 0
        hi[busy[is_set]] = mid[is_set]
        lo[busy[~is_set]] = mid[~is_set] + 1


def _rotate(fp: np.ndarray, blocks: tuple[int, int]) -> np.ndarray:
    """The chosen blocks on top, the others below."""
    order = [*blocks, *(b for b in range(BLOCKS) if b not in blocks)]
    mask, out = np.uint64((1 << BLOCK_BITS) - 1), np.zeros_like(fp)
    for place, block in enumerate(order):
        part = fp >> np.uint64(BLOCK_BITS * (BLOCKS - 1 - block)) & mask
        out |= part << np.uint64(BLOCK_BITS * (BLOCKS - 1 - place))
    return out


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): for each task a spanning forest of all pairs of ``distinct.fp`` within ``budget`` bits, a the smaller."""
    if not 0 <= budget <= BUDGET:
        raise ValueError(f"two exact blocks of {BLOCKS} are guaranteed for budgets up to {BUDGET}")
    choices = [*combinations(range(BLOCKS), 2)]
    shift = lambda b: BLOCK_BITS * (BLOCKS - 1 - b)
    block = lambda b: F.shiftrightunsigned("fp", shift(b)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    tries = F.array(*(F.struct(F.lit(k).alias("trie"), F.shiftleft(block(i), BLOCK_BITS).bitwiseOR(block(j)).alias("top")) for k, (i, j) in enumerate(choices)))
    placed = distinct.select("fp", F.explode(tries).alias("t")).select("fp", "t.trie", "t.top")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # subtries follow one another; whole ones are joined as they end, CHUNK fingerprints or more at a time
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            part = tuple(batch.column(c).to_numpy() for c in ("trie", "top", "fp"))
            n = len(part[0])
            if not n:
                continue
            last = int(np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))[-1]) + 1 if (part[0][0], part[1][0]) != (part[0][-1], part[1][-1]) else 0
            if held and (last or (held[-1][0][-1], held[-1][1][-1]) != (part[0][0], part[1][0])) and size + last >= CHUNK:
                yield _joined([*held, tuple(x[:last] for x in part)], choices, budget)
                held, size, part = [], 0, tuple(x[last:] for x in part)
            held.append(part)
            size += len(part[0])
        if size:
            yield _joined(held, choices, budget)

    dealt = placed.repartition("trie", "top").sortWithinPartitions("trie", "top")
    return dealt.mapInArrow(task, "a long, b long").distinct()


def _joined(parts: list[tuple[np.ndarray, ...]], choices: list[tuple[int, int]], budget: int) -> pa.RecordBatch:
    """Spanning forests over whole subtries, as (a, b)."""
    trie, _, fp = (np.concatenate(x) for x in zip(*parts))
    fp, ends = fp.view(np.uint64), []
    for k, blocks in enumerate(choices):
        own = fp[trie == k]
        keys = _rotate(own, blocks)
        order = np.argsort(keys)
        keys, own = keys[order], own[order]
        forest = Forest(len(keys))
        trie_join(keys, BLOCK_BITS * 2, budget, forest.union)
        every = np.arange(len(keys))
        root = forest.roots(every)
        hooked = root != every
        ends.append((own[root[hooked]].view(np.int64), own[hooked].view(np.int64)))
    a, b = (np.concatenate(x) for x in zip(*ends))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a < b), root the smallest node of its component.

    Large star: each node's greater neighbours move to its smallest neighbour; small star: each
    node's smaller neighbours do. Both are a minimum by key, pre-aggregated, and a join with it, in
    which the edges of a hub stay where they are. Each round's edges replace the last one's on disk.
    """
    edges = materialize(edges, "edges")
    while total := 2 * edges.count():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = materialize(keyed_join(both.where("b > a"), least, ["a"], total).select(F.col("m").alias("a"), "b").where("a < b").distinct(), "large")
        up = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = keyed_join(large, up, ["b"], total).select("m", F.explode(F.array("a", "b")).alias("v")).where("m < v").select(F.col("m").alias("a"), F.col("v").alias("b"))
        after = materialize(small.distinct(), "edges")
        discard(edges, large)
        # done when every node hangs on one root that hangs on nothing
        roots = after.select(F.col("a").alias("b")).distinct()
        busy = after.groupBy("b").count().where("count > 1").select("b").unionAll(after.join(roots, "b", "left_semi").select("b"))
        edges = after
        if busy.isEmpty():
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    each = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    rooted = components(links(each.select("fp"), budget))
    named = each.join(rooted, each["fp"] == rooted["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(named.join(ids, "root").select("fp", "component_id", "n"), "components")
    return keyed_join(marked, of, ["fp"], marked.count()).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of each root in rooted(doc_id, th, root), a row for each of ``docs``, the first row by doc_id and text hash."""
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    chosen = rooted.groupBy("root").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("rep_id"), F.col("p.th").alias("rep_th"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), th.alias("th"))
    if not rooted.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["id", "th"])
    on = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))
    return rows.join(chosen.hint("shuffle_hash"), on, "left_semi").select("row.*")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
