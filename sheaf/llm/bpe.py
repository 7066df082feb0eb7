"""Byte-level BPE as a monoid: halves are encoded on their own, and neighbours joined at the seam.

Why a join is right. Call two adjacent tokens stable if their joined bytes encode to just these two.
Where every adjacent pair of a token sequence is stable, the sequence is the encoding of its bytes: take the
first merge across a seam that encoding the whole would make. Until then what happened inside the seam's two
tokens is what happens in these two alone, so that merge would also occur there, and the pair were not stable.
So a window around the seam is encoded anew and grown until the pairs at both of its edges are stable; pairs
farther out are stable already, being neighbours in a valid encoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from sheaf.llm.common import map_batches

#: Pieces of at most this many bytes are merged directly; longer ones are halved.
LEAF_BYTES = 24
#: Encodings of pieces and seams kept by one Python worker, and the longest piece of which one is kept (in characters):
#: together the memory bound of the operator.
CACHED_PIECES, CACHED_LENGTH = 150_000, 64

#: The rank of what has none.
_NONE = 1 << 60

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBPE:
    """Encoder and decoder over fixed ranks. One per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.kept = lru_cache(CACHED_PIECES)(self._encode_piece)
        self.stable = lru_cache(CACHED_PIECES // 4)(self._stable)

    # -- the leaves -----------------------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, the leftmost first, until none has a rank."""
        if len(data) > 4 * LEAF_BYTES:
            return self._merge_long(data)
        rank_of = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank_of(data[i : i + 2], _NONE) for i in range(len(data) - 1)]  # the rank of each part with the next
        while pairs and (least := min(pairs)) != _NONE:
            at = pairs.index(least)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = rank_of(parts[at - 1] + parts[at], _NONE)
            if at < len(pairs):
                pairs[at] = rank_of(parts[at] + parts[at + 1], _NONE)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over a linked list, for windows that had to grow."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # where the part that starts at i ends; 0: merged away
        before = list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (p := before[i]) >= 0 and (rank := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (rank, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    # -- the monoid -----------------------------------------------------------------------------------

    def _stable(self, left: int, right: int) -> bool:
        return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of left's and right's bytes together; the empty list is the unit."""
        if not left or not right:
            return left or right
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self.merge(self.decode(left[i:] + right[:j]))
            if (i == 0 or self.stable(left[i - 1], window[0])) and (j == len(right) or self.stable(window[-1], right[j])):
                return left[:i] + window + right[j:]
            reach *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        return self.kept(piece) if len(piece) <= CACHED_LENGTH else self._encode_piece(piece)

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.encode_bytes(data))

    # -- texts ----------------------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """Pieces of the pattern never merge with each other, so their encodings are joined as they are."""
        ids: list[int] = []
        for piece in map(self.encode_piece, self.pieces(text)):
            ids += piece
        return ids

    def decode(self, ids: list[int], leaf: int = 4096) -> bytes:
        """Concatenates up the tree: leaves of some thousand tokens, then halves."""
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


_worker: dict[tuple, ByteBPE] = {}


def _codec(ranks: dict[bytes, int], pattern: str, name: str) -> ByteBPE:
    if (key := (name, pattern)) not in _worker:
        _worker.clear()
        _worker[key] = ByteBPE(ranks, pattern)
    return _worker[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text of (doc_id, text).

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids and decoded (binary).
    A null text counts as empty: no tokens, and the digests of no bytes. A row in gives a row out, so repeated
    rows repeat, and an empty table gives none; other columns are ignored. Long texts take memory in proportion to the one text. The rank
    file is of fixed size (under 1 MB) and read by the driver; its content is broadcast.
    """
    ranks = load_ranks(ranks_path)
    name = hashlib.sha256(repr(sorted(ranks.items(), key=lambda x: x[1])).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    digits: dict[int, str] = {}

    def batch(rows) -> dict:
        codec = _codec(shared.value, pattern, name)
        if not digits:
            digits.update((i, str(i)) for i in codec.bytes_of)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for text in rows.column("text").to_pylist():
            ids = codec.encode(text or "")
            decoded = codec.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            if keep_ids:
                out["ids"].append(ids)
                out["decoded"].append(decoded)
        return out | {"doc_id": rows.column("doc_id")}

    return map_batches(docs.select("doc_id", "text"), batch, SCHEMA + (", ids array<int>, decoded binary" if keep_ids else ""))
