"""Near-duplicates by SimHash: fingerprints, BK-trees in shards of fingerprints, components of the links.

Two 64-bit fingerprints that differ in at most two bits agree in at least two of four 16-bit blocks, so for one
of the six pairs of blocks both fall into the same shard (pair, value of both blocks). A shard above SHARD
fingerprints is divided again, by pairs of the four bytes outside its two blocks: such a shard has 16 free bits,
so it can't exceed 65,536 distinct fingerprints. Every shard gets a BK-tree of its own; no link is lost.

A broadcast of the trees would have to pass all fingerprints through the driver. So a shard's tree is built where
its queries already are: both reach the same task by one shuffle of distinct fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import checkpoint, join_groups, map_batches, texts_as_bytes
from sheaf.llm.components import components

RADIUS = 2
#: Distinct fingerprints in a shard beyond which it is divided again.
SHARD = 2048
#: Shingle hashes counted at once: bounds the memory for a very long text.
CHUNK = 1 << 16
#: The most frequent fingerprints, whose rows get their component by a broadcast (24 bytes each) when there are more.
BROADCAST_PRINTS = 200_000


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash over word shingles: a bit is 1 if set in over half of their XXH64 (seed 42)."""
    parts = (text or b"").lower().split()  # on bytes: only A-Z, and only the six blanks
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    spans = zip(starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[a:b], 42) for a, b in spans], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of docs."""

    def batch(rows: pa.RecordBatch) -> dict:
        values = np.array([fingerprint(t) for t in texts_as_bytes(rows)], dtype=np.uint64)
        return {"doc_id": rows.column("doc_id"), "fp": values.view(np.int64)}

    return map_batches(docs.select("doc_id", "text"), batch, "doc_id long, fp long")


class BKTree:
    """A Burkhard-Keller tree over distinct unsigned 64-bit values; children hang at their distance to the parent.

    The tree is held as arrays and both built and searched for many values at once.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.edges: dict[int, list[tuple[int, int]]] = {}  # parent -> (distance, child)
        self.root = 0 if len(values) else None
        work = [np.arange(len(values))] if len(values) else []
        while work:
            members = work.pop()
            node, rest = int(members[0]), members[1:]
            if not len(rest):
                continue
            far = np.bitwise_count(values[rest] ^ values[node])
            order = np.argsort(far, kind="stable")
            rest, far = rest[order], far[order]
            cuts = np.flatnonzero(np.diff(far)) + 1
            groups = np.split(rest, cuts)
            self.edges[node] = [(int(far[c]), int(g[0])) for c, g in zip([0, *cuts.tolist()], groups, strict=True)]
            work += groups

    def search(self, queries: np.ndarray, radius: int):
        """Yields (node, places in queries) for each node with queries within radius."""
        work = [(self.root, np.arange(len(queries)))] if self.root is not None else []
        while work:
            node, asked = work.pop()
            far = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int16)
            if len(hits := asked[far <= radius]):
                yield node, hits
            for distance, child in self.edges.get(node, ()):
                near = asked[np.abs(far - distance) <= radius]
                if len(near):
                    work.append((child, near))


def linked(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of some distinct values, the least place that it is linked to, through others or directly."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(values) > 1:
        for node, hits in BKTree(values).search(values, radius):
            for hit in hits.tolist():
                low, high = sorted((root(node), root(hit)))
                parent[high] = low
    return np.array([root(i) for i in range(len(values))], np.int64)


def _shards(distinct: DataFrame) -> DataFrame:
    """kind, key, fp, rep: each fingerprint once in each of its shards, hot ones divided further."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs = list(combinations(range(4), 2))
    coarse = distinct.select("fp", "rep", F.posexplode(F.array(*(F.shiftleft(block(i), 16).bitwiseOR(block(j)) for i, j in pairs))).alias("kind", "key"))
    hot = coarse.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("kind", "key", F.lit(True).alias("hot"))
    marked = coarse.join(hot, ["kind", "key"], "left")
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(0xFF))
    finer = None
    for k, (i, j) in enumerate(pairs):
        free = [b for x in range(4) if x not in (i, j) for b in (2 * x, 2 * x + 1)]
        keys = F.array(*(F.shiftleft(byte(a), 8).bitwiseOR(byte(b)) for a, b in combinations(free, 2)))
        finer = F.when(F.col("kind") == k, keys) if finer is None else finer.when(F.col("kind") == k, keys)
    cold = marked.where("hot is null").select(F.col("kind").cast("int").alias("kind"), "key", "fp", "rep")
    divided = marked.where("hot").select("fp", "rep", "kind", "key", F.posexplode(finer).alias("sub", "low")).select((6 + F.col("kind") * 6 + F.col("sub")).cast("int").alias("kind"), F.shiftleft("key", 16).bitwiseOR(F.col("low")).alias("key"), "fp", "rep")
    return cold.unionByName(divided)


def _star_links(batches):
    """Sorted rows of whole shards in; for each shard's linked fingerprints an edge to the least representative."""
    held: list[pa.RecordBatch] = []
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: pa.Table):
        kind, key, fp, rep = (rows.column(c).to_numpy() for c in ("kind", "key", "fp", "rep"))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1
        begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        a, b = [], []
        for i, j in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
            reps = rep[i:j]
            label = linked(fp[i:j].view(np.uint64))
            least = np.full(j - i, np.iinfo(np.int64).max)
            np.minimum.at(least, label, reps)
            roots = least[label]
            a.append(reps[roots != reps])
            b.append(roots[roots != reps])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        first = (batch.column("kind")[0], batch.column("key")[0])
        if held and first != (held[-1].column("kind")[-1], held[-1].column("key")[-1]):
            yield from links(pa.Table.from_batches(held))
            held = []
        last = (batch.column("kind")[-1], batch.column("key")[-1])
        if first == last:  # the shard may go on
            held.append(batch)
            continue
        same = (batch.column("kind").to_numpy() == last[0].as_py()) & (batch.column("key").to_numpy() == last[1].as_py())
        cut = int(np.argmax(same))
        yield from links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
        held = [batch.slice(cut)]
    if held:
        yield from links(pa.Table.from_batches(held))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of (doc_id, text).

    component_id is the least doc_id reachable over links of at most two differing bits, the row's own included.
    Null, empty and wordless texts have fingerprint zero, which links like any other. Rows with the same doc_id count
    as nodes of their own fingerprints. A null doc_id is kept, and its row links like any other; it is never a
    component's id unless all are null.
    No fingerprint, link or component passes the driver; text is read once and never shuffled. A long text takes memory in
    proportion to itself; other columns are ignored; an empty table gives none.
    """
    hashed = checkpoint(fingerprints(docs))
    # The nodes are the fingerprints themselves, as some have no id; a component's least id is taken afterwards.
    distinct = checkpoint(hashed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("weight")))
    shards = _shards(distinct.select("fp", F.col("fp").alias("rep")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = shards.repartition(n, "kind", "key").sortWithinPartitions("kind", "key", "fp").mapInArrow(_star_links, "a long, b long")
    roots = components(edges)
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "weight", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # Read more than once by join_groups where there are many. Rows of one text share a fingerprint, which may be a hot key.
    known = checkpoint(placed.join(named, "root").select("fp", "component_id", "weight"))
    return join_groups(hashed, known, "fp", BROADCAST_PRINTS, how="left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
