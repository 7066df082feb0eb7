"""Benchmark decontamination over a distributed positional inverted index of the training tokens.

The index is cut by documents: a segment holds the postings of all words of some whole documents, positions counted
through the segment with a gap after each document. It is stored once and knows nothing of the tests. A search takes the
phrases whose rarest test term the segment holds, leaves those of which it lacks a term, and intersects the lists of the
others, each shifted by its term's place in the phrase, beginning with the rarest. No posting is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import arrow_schema, checkpoint, map_batches, spread

#: Lower-cases A-Z and turns what stands between words into spaces; bytes of other letters are parts of words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: A segment is closed at so many words (a document is never split).
SEGMENT_WORDS = 1 << 20
#: Test words taken at once. A larger benchmark is searched in blocks of about this size, so what is broadcast is bounded
#: (4 bytes for each word of a window, and the terms).
BLOCK_WORDS = 500_000
WINDOW = 10
#: In a proximity search: how far from a window's rarest word its others may stand.
SPAN = 20

INDEX_SCHEMA = "doc_ids array<long>, n_words array<long>, base array<long>, terms binary, counts binary, gaps binary"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Queries:
    """The windows of some test items as phrases over their terms, ordered by key: the term that the fewest phrases hold (ties: by its bytes)."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        phrases: dict[tuple[bytes, ...], list] = {}
        for item, text in items:
            found = words(text)
            for i in range(max(1, len(found) - window + 1) if found else 0):
                owners = phrases.setdefault(tuple(found[i : i + window]), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        held = Counter(w for p in phrases for w in set(p))
        self.terms = {w: i for i, w in enumerate(sorted(held, key=lambda w: (held[w], w)))}
        numbers = sorted((min(ids := [self.terms[w] for w in p]), ids, owners) for p, owners in phrases.items())
        self.sizes = np.array([len(ids) for _, ids, _ in numbers], np.int32)
        self.owners = [owners for _, _, owners in numbers]
        # A row for each phrase, filled up with its key; the phrases of a key stand from first[key] on.
        self.rows = np.array([ids + [key] * (window - len(ids)) for key, ids, _ in numbers], np.int32).reshape(-1, window)
        self.first = np.searchsorted(np.array([key for key, _, _ in numbers]), np.arange(len(self.terms) + 1))

    def candidates(self, present: np.ndarray) -> np.ndarray:
        """Phrases of which all terms are present, looked up by the present keys."""
        keys = np.flatnonzero(present & (np.diff(self.first) > 0))
        if not len(keys):
            return np.empty(0, np.int64)
        some = np.concatenate([np.arange(self.first[k], self.first[k + 1]) for k in keys])
        return some[present[self.rows[some]].all(axis=1)]


class _Numbers(dict):
    """Words to the numbers in which they first came."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def build_index(docs: DataFrame) -> DataFrame:
    """The index of (doc_id, text): a row for each segment, its postings as terms, how often each stands, and gaps between positions.

    Null text has no words; a row in is a document, repeated rows too. Postings are compressed, to about 2 bytes a word.
    A task's memory follows its segment: SEGMENT_WORDS, or the one longer document.
    """
    schema = arrow_schema(INDEX_SCHEMA)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        doc_ids, lengths, bases, tokens, total = [], [], [], [], 0
        pack = zstandard.ZstdCompressor(level=1).compress

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(tokens)
            at = np.flatnonzero(ids >= 0).astype(np.int32)
            order = np.argsort(ids[at], kind="stable")
            counts = np.bincount(ids[at], minlength=len(number)).astype(np.int32)
            gaps = at[order]
            starts = np.cumsum(counts[:-1]) if len(counts) else counts
            held = gaps[starts]
            gaps[1:] -= gaps[:-1].copy()
            gaps[starts] = held
            row = [doc_ids, lengths, bases, pack(b" ".join(number)), pack(counts.tobytes()), pack(gaps.tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        gap = np.full(1, -1, np.int32)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = words(text.cast(pa.binary()).as_py())
                doc_ids.append(doc_id)
                lengths.append(len(found))
                bases.append(total)
                tokens += [np.fromiter(map(number.__getitem__, found), np.int32, len(found)), gap]
                total += len(found) + 1
                if total >= SEGMENT_WORDS:
                    yield segment()
                    number, doc_ids, lengths, bases, tokens, total = _Numbers(), [], [], [], [], 0
        if doc_ids:
            yield segment()

    return spread(docs.select("doc_id", "text")).mapInArrow(segments, INDEX_SCHEMA)


class Segment:
    """A row of the index, opened for the terms of some queries; other lists stay as they are."""

    def __init__(self, row: dict, terms: dict[bytes, int]):
        unpack = zstandard.ZstdDecompressor().decompress
        self.doc_ids, self.n_words, self.base = row["doc_ids"], row["n_words"], np.array(row["base"], np.int64)
        ends = np.cumsum(np.frombuffer(unpack(row["counts"]), np.int32))
        gaps = np.frombuffer(unpack(row["gaps"]), np.int32)
        held = unpack(row["terms"])
        self.lists = {}
        for i, w in enumerate(held.split(b" ") if held else ()):
            if (term := terms.get(w)) is not None:
                self.lists[term] = np.cumsum(gaps[ends[i - 1] if i else 0 : ends[i]], dtype=np.int64)
        self.present = np.zeros(len(terms), bool)
        self.present[list(self.lists)] = True

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Where the terms stand one after the other: shifted lists intersected, from the rarest on."""
        lists = [self.lists[t] for t in terms]
        order = sorted(range(len(terms)), key=lambda i: len(lists[i]))
        starts = lists[order[0]] - order[0]
        for i in order[1:]:
            if not len(starts):
                break
            place = np.searchsorted(lists[i], starts + i)
            place[place == len(lists[i])] = 0
            starts = starts[lists[i][place] == starts + i]
        return starts

    def proximity(self, terms: list[int], span: int) -> np.ndarray:
        """Positions of the term of least number around which each of the terms stands within span words, in the same document."""
        at = self.lists[min(terms)]
        for x in sorted((self.lists[t] for t in set(terms)), key=len):
            doc = np.searchsorted(self.base, at, "right") - 1
            low = np.maximum(at - span, self.base[doc])
            high = np.minimum(at + span, self.base[doc] + np.array(self.n_words, np.int64)[doc] - 1)
            place = np.searchsorted(x, low)
            at = at[(place < len(x)) & (x[np.minimum(place, len(x) - 1)] <= high)]
        return at

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, positions, "right") - 1


def _open(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[tuple[int, Segment]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            yield row["segment"], Segment(row, queries.terms)


HITS_SCHEMA = "segment long, place long, doc_id long, n_words long, hits array<struct<start:int,stop:int>>, items array<long>"


def search_phrases(index: DataFrame, queries: Queries) -> DataFrame:
    """For each document of the index (with a column segment): n_words, hits (disjoint word ranges within occurrences, end exclusive) and items found (null last)."""
    shared = index.sparkSession.sparkContext.broadcast(queries)
    schema = arrow_schema(HITS_SCHEMA)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for number, segment in _open(batches, asked):
            n = len(segment.doc_ids)
            ranges: dict[int, list] = {}
            items: dict[int, set] = {}
            for p in asked.candidates(segment.present).tolist():
                size = int(asked.sizes[p])
                if len(starts := segment.phrase(asked.rows[p, :size].tolist())):
                    doc = segment.documents(starts)
                    for d, s in zip(doc.tolist(), (starts - segment.base[doc]).tolist(), strict=True):
                        ranges.setdefault(d, []).append((s, s + size))
                        items.setdefault(d, set()).update(asked.owners[p])
            listed = [sorted(items.get(d, ()), key=lambda x: (x is None, x or 0)) for d in range(n)]
            columns = [[number] * n, range(n), segment.doc_ids, segment.n_words, [merge(ranges.get(d, [])) for d in range(n)], listed]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return index.mapInArrow(search, HITS_SCHEMA)


def search_proximity(index: DataFrame, queries: Queries, span: int = SPAN) -> DataFrame:
    """doc_id, item_id and position (in the document) of the rarest test term of a window of the item, where all words of the window stand within span words of it, in any order."""
    shared = index.sparkSession.sparkContext.broadcast(queries)
    schema = pa.schema([("segment", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("position", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for number, segment in _open(batches, asked):
            found: set[tuple] = set()
            for p in asked.candidates(segment.present).tolist():
                at = segment.proximity(asked.rows[p, : asked.sizes[p]].tolist(), span)
                doc = segment.documents(at)
                found.update((d, item, s) for d, s in zip(doc.tolist(), (at - segment.base[doc]).tolist(), strict=True) for item in asked.owners[p])
            rows = [(number, d, segment.doc_ids[d], item, s) for d, item, s in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return index.mapInArrow(search, "segment long, place long, doc_id long, item_id long, position long")


def merge(ranges: list) -> list:
    """Disjoint ranges of the same places; ranges that touch are joined."""
    out: list = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], stop)
        else:
            out.append({"start": start, "stop": stop})
    return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list]:
    """The test items in blocks of about block_words words, fetched one after the other."""
    block, n = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        block.append((row["item_id"], bytes(row["text"]) if row["text"] is not None else None))
        n += len(words(block[-1][1]))
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def stored_index(docs: DataFrame) -> DataFrame:
    """build_index(docs), written to the shared folder, with a number for each segment."""
    return checkpoint(build_index(docs).withColumn("segment", F.monotonically_increasing_id()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hits and items for each row of docs, against all items of (item_id, text).

    An item's windows are its runs of window words, or all of it if shorter; a document word is hit if inside any
    occurrence of one. Null, empty and wordless items have no window, and such documents no hit. Repeated items count by
    their item_id, null being an id of its own; repeated documents row by row. Other columns are ignored. Empty docs give
    no row, and an empty benchmark no hit. The index is built once; the benchmark is searched a block at a time, and with
    more than one, each row's findings are united afterwards.
    """
    index = stored_index(docs)
    source = blocks(benchmark, block_words)
    block, after = next(source, []), next(source, None)
    found = search_phrases(index, Queries(block, window))
    if after is None:
        return found.select("doc_id", "n_words", "hits", "items")
    parts = found.where("size(hits) > 0")
    while after is not None:
        parts = checkpoint(parts.unionByName(search_phrases(index, Queries(after, window)).where("size(hits) > 0")))
        after = next(source, None)
    together = parts.groupBy("segment", "place").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def batch(rows: pa.RecordBatch) -> dict:
        return {"segment": rows.column("segment"), "place": rows.column("place"), "items": rows.column("items"), "hits": [merge([(r["start"], r["stop"]) for r in x]) for x in rows.column("hits").to_pylist()]}

    united = map_batches(together, batch, "segment long, place long, hits array<struct<start:int,stop:int>>, items array<long>")
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d")).select("segment", F.col("place").cast("long").alias("place"), "d.*")
    nothing = {"hits": F.lit([]).cast("array<struct<start:int,stop:int>>"), "items": F.lit([]).cast("array<long>")}
    return rows.join(united, ["segment", "place"], "left").select(F.col("doc_ids").alias("doc_id"), "n_words", *(F.coalesce(k, v).alias(k) for k, v in nothing.items()))


def near_items(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id and n_places: the rows of docs where all words of a window of an item stand close together, in any order.

    Windows are as in contamination(); n_places counts the places of the windows' rarest words (those that the fewest
    windows of the block hold) around which the others stand within span words. It finds what contamination() does, and
    windows with words moved or put in between.
    """
    index, parts = stored_index(docs), None
    for block in blocks(benchmark, block_words):
        part = search_proximity(index, Queries(block, window), span)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = search_proximity(index, Queries([], window), span)
    return parts.groupBy("segment", "place", "doc_id", "item_id").agg(F.countDistinct("position").alias("n_places")).select("doc_id", "item_id", "n_places")


def summary(found: DataFrame) -> DataFrame:
    """The counts and digest of contamination()'s rows. An item without an id counts in n_items; the digest can't name it."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + (r["stop"] - r["start"]))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
