"""SimHash near-dedup at a stated similarity: retrieval by fingerprints and bands, decision by whole texts.

Texts of a similarity of 0.8 in 5-word shingles differ in far more of a fingerprint's 64 bits than a
trie self-join can allow (4 to 14 where measured), so ``simhash`` alone would find next to none of them.
Here its self-join is one of two ways to candidates; the other is 24 MinHash bands of 5 rows over the
same shingles' hashes, where two sets of similarity 0.8 share a band with a chance of
1 - (1 - 0.8^5)^24 = 0.9999. Every candidate is verified by the exact Jaccard similarity of the two whole sets.

Words are separated by white space, A-Z lower-cased; a text's set holds the 64-bit hashes of its runs
of ``SHINGLE`` words, of all its words if they are fewer. Equal sets are one node. Nodes are sorted by
band key, in ranges, so a key of any size is read by several tasks as a stream. Up to ALL_PAIRS nodes of
a key are paired all with all; of more, each is paired with the first of its task's stretch and with the
next one, which joins close copies in proportion to their number. Keys that hold nodes of several
components after that are settled exactly: each node outside the key's largest component is compared, in
blocks, with every node of the key that it isn't connected to yet. So no link between sets that share
a band is lost, and what is compared twice is only what the first round left apart.

Verification deals pairs by their first node, in parts of PART; a task holds one set at a time, a block
of sets in the last step, and reads the others' texts as a stream.

Defined results: null, empty and blank texts have the empty set and are one group; a null doc_id is
carried along and stays only if all of its group's are null; repeated rows and ties are one group, of
which the smallest doc_id, then the smallest text hash stays; a very long text is hashed in parts; an
empty table gives no rows; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, keyed_join, materialize, pieces
from .simhash import _TO_LOWER, SEED, _space, components, representatives

SHINGLE = 5
BANDS, ROWS = 24, 5
ALL_PAIRS = 32
PART = 4096
BLOCK = 256
CHUNK = 1 << 13
#: The least similarity as a fraction.
LEAST = (4, 5)
_rng = np.random.default_rng(17)
_multipliers = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None] | np.uint32(1)
_offsets = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_mixers = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def _hash_parts(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, in parts."""
    import xxhash

    hashed, carried, any_part = xxhash.xxh64_intdigest, [], False
    for part in pieces(text or ""):
        words = carried + [w for w in _space.split(part.translate(_TO_LOWER)) if w]
        total = len(words) - SHINGLE + 1
        if total > 0:
            any_part = True
            yield np.fromiter((hashed(s, SEED) for s in map(" ".join, zip(*(words[k:] for k in range(SHINGLE))))), np.uint64, total)
            carried = words[total:]
        else:
            carried = words
    if carried and not any_part:
        yield np.array([hashed(" ".join(carried), SEED)], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Ascending distinct hashes of the shingles."""
    parts = [np.unique(p) for p in _hash_parts(text)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))


def sketch(text: str | None) -> tuple[np.ndarray, int]:
    """The shingle set and the fingerprint over the same hashes, repeats counted."""
    counts, total, parts = np.zeros(64, np.int64), 0, []
    for hashes in _hash_parts(text):
        for at in range(0, len(hashes), simhash.CHUNK):
            part = hashes[at : at + simhash.CHUNK]
            counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        parts.append(np.unique(hashes))
    own = parts[0] if len(parts) == 1 else np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))
    return own, int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets have a similarity of LEAST or more."""
    up, down = LEAST
    if down * min(len(a), len(b)) < up * max(len(a), len(b)):
        return False
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return (up + down) * shared >= up * (len(a) + len(b))


def bands(shingles: np.ndarray) -> np.ndarray:
    """One key for each band; none for the empty set, which is a single node."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), CHUNK):
        x = (low[at : at + CHUNK] + _offsets) * _multipliers
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        np.minimum(least, x.min(axis=1), out=least)
    keys = (least.reshape(BANDS, ROWS) * _mixers).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _hash_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, fp, keys) for each row: hash of the text, hash of the set, fingerprint, bands."""
    import xxhash

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t.as_py()) for t in batch.column("text")]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s, _ in found], np.uint64)
            fps = np.array([f for _, f in found], np.uint64)
            keys = pa.array([bands(s).view(np.int64) for s, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), keys], ["doc_id", "th", "node", "fp", "keys"])

    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long"), text.alias("text"), _hash_of(text).alias("th"))
    return source.mapInArrow(task, "doc_id long, th long, node long, fp long, keys array<long>")


def _stretches(placed: DataFrame) -> DataFrame:
    """Of placed(key, node), rows (kind, key, a, b): 0 a pair of nodes, 1 a task's stretch of a key: its first node and its size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = first = last = None
        size, few, opening = 0, [], True

        def close(edge: bool) -> None:
            if edge or size > ALL_PAIRS:
                out.append((1, key, first, size))

        for batch in batches:
            for k, node in zip(batch.column("key").to_pylist(), batch.column("node").to_pylist()):
                if k != key:
                    if size:
                        close(opening)
                        opening = False
                    key, first, last, size, few = k, node, node, 1, [node]
                    continue
                if node == last:
                    continue
                size += 1
                if size <= ALL_PAIRS:
                    out += [(0, key, other, node) for other in few]
                    few.append(node)
                else:
                    out += [(0, key, first, node), (0, key, last, node)]
                last = node
            if len(out) >= CHUNK:
                yield _rows(out)
                out = []
        if size:
            close(True)
        yield _rows(out)

    ordered = placed.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(task, "kind int, key long, a long, b long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows)] or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["kind", "key", "a", "b"])


def _texts(docs: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of nodes(node), from one row of each."""
    place = F.struct("th", F.col("doc_id").isNull().alias("none"), "doc_id")
    one = marked.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(place).alias("p")).select("node", F.col("p.th").alias("nh"), F.col("p.doc_id").alias("nid"))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), _hash_of(text).alias("th"))
    found = rows.join(one, F.col("id").eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nh")))
    return materialize(found.select("node", "text"), "texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are similar. A first node's set is held, the others' texts are a stream."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, part, y, text in zip(*(batch.column(c) for c in ("a", "part", "b", "text"))):
                x, part, y = x.as_py(), part.as_py(), y.as_py()
                if y is None:
                    if held != x:
                        held, own = x, shingle_set(text.as_py())
                elif held == x and y not in b[-1:] and similar(own, shingle_set(text.as_py())):
                    a.append(min(x, y))
                    b.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    parts = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    dealt = keyed_join(pairs, parts, ["a"], pairs.count()).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    firsts = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    return firsts.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(task, "a long, b long").distinct()


def _apart(placed: DataFrame, large: DataFrame, rooted: DataFrame) -> DataFrame:
    """(key, node, root, probe) of the keys in large(key) whose nodes are of several components; probes are outside the largest."""
    members = placed.join(large, "key", "left_semi").join(rooted.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    members = materialize(members.select("key", "node", F.coalesce("root", "node").alias("root")), "large-keys")
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("m"))
    chief = sizes.groupBy("key").agg(F.max(F.struct("m", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("most.root").alias("chief"))
    return members.join(chief, "key").select("key", "node", "root", (F.col("root") != F.col("chief")).alias("probe"))


def _settled(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of similar nodes of a key in different components: probes against all, in blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, probes = None, []
        for batch in batches:
            a, b = [], []
            for key, pb, mb, role, node, root, text in zip(*(batch.column(c) for c in ("key", "pb", "mb", "role", "node", "root", "text"))):
                place, node, root = (key.as_py(), pb.as_py(), mb.as_py()), node.as_py(), root.as_py()
                if place != held:
                    held, probes = place, []
                own = shingle_set(text.as_py())
                if not role.as_py():
                    probes.append((node, root, own))
                    continue
                for other, of, theirs in probes:
                    if of != root and similar(own, theirs):
                        a.append(min(node, other))
                        b.append(max(node, other))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = apart.groupBy("key").agg(blocks(F.sum(F.col("probe").cast("long"))).alias("ps"), blocks(F.count("*")).alias("ms"))
    spots = apart.join(sizes, "key").withColumn("h", F.xxhash64(F.lit("block"), "node"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    probes = spots.where("probe").select("key", own("ps").alias("pb"), upto("ms").alias("mb"), F.lit(0).alias("role"), "node", "root")
    others = spots.select("key", upto("ps").alias("pb"), own("ms").alias("mb"), F.lit(1).alias("role"), "node", "root")
    rows = probes.unionByName(others).join(texts, "node")
    return rows.repartition("key", "pb", "mb").sortWithinPartitions("key", "pb", "mb", "role").mapInArrow(task, "a long, b long").distinct()


def roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' marks (doc_id, th, node), and (node, root, n) of all nodes, n being a node's rows."""
    marked = materialize(_marked(docs), "marks")
    nodes = materialize(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("n")), "nodes")
    placed = nodes.select("node", F.explode(F.array_append("keys", F.xxhash64(F.lit("fp"), "fp"))).alias("key")).where("node != 0")
    read = materialize(_stretches(placed), "stretches")
    # stretches of one key in several tasks: their first nodes are paired with the smallest
    stretches = read.where("kind = 1").select("key", F.col("a").alias("node"), F.col("b").alias("size"))
    least = stretches.groupBy("key").agg(F.min("node").alias("a"), F.sum("size").alias("size"))
    across = stretches.join(least, "key").where("node > a").select("a", F.col("node").alias("b"))
    of_fp = nodes.where("node != 0").groupBy("fp").agg(F.min("node").alias("node"))
    near = simhash.links(of_fp.select("fp")).join(of_fp.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = materialize(read.where("kind = 0").select("a", "b").unionByName(across).unionByName(near).distinct(), "pairs")
    texts = _texts(docs, marked, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = materialize(_verified(pairs, texts), "links")
    rooted = components(links)
    apart = materialize(_apart(placed, least.where(F.col("size") > ALL_PAIRS).select("key"), rooted), "apart")
    discard(read, pairs)
    if not apart.isEmpty():
        rooted = components(links.unionByName(_settled(apart, texts)))
    named = nodes.join(rooted.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    named = materialize(named.select("node", F.coalesce("root", "node").alias("root"), "n"), "roots")
    discard(texts, links, apart, nodes)
    return marked.select("doc_id", "th", "node"), named


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of linked texts: the smallest doc_id (null last), then the smallest text hash."""
    marked, named = roots(docs)
    return representatives(docs, keyed_join(marked, named, ["node"], marked.count()))
