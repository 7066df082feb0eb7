"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word goes in as its own vector and the mean of the vectors of its character n-grams. Two gated recurrent layers read
a window of words forwards and backwards, attention weighs the words, and a linear layer gives the window's logit. A
document's score is that of its highest of all overlapping windows, whole text included.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import bucket_of, map_batches

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
#: Places that character 3- and 4-grams are hashed to.
CHAR_PLACES = 1 << 13
#: Bounds of the fit: toxic and other documents (drawn by a hash of the id), and bytes of a document that is learned from.
FIT_TOXIC, FIT_OTHER, FIT_BYTES = 1200, 2400, 1 << 16
#: Words in fewer texts of the sample are known by their characters only.
LEAST_TEXTS = 3
#: Distinct words whose projections a Python worker keeps, and windows scored at once: the bounds of its memory.
CACHED_WORDS, BATCH_WINDOWS = 100_000, 1024
#: In training: windows at random of a text with label 0, share of word vectors dropped, decay of the weights.
OTHERS, DROPPED, DECAY = 2, 0.5, 1e-4
#: Weight of a label 1 that nothing in its text bears out.
DOUBTED = 0.05

#: Lower-cases A-Z; all ASCII but letters and digits parts words.
_FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def char_grams(many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 3- and 4-grams of words between marks, and where each word's begin. A word has at least one."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in many), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, many), np.int64, len(many)) + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(many)), sizes)
    places, owners = [], []
    for n in (3, 4):
        if len(data) < n:
            continue
        code = sum(data[i : len(data) - n + 1 + i] << np.uint64(8 * i) for i in range(n))
        mixed = ((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
        at = np.arange(len(code))
        inside = at + n <= ends[owner[: len(code)]]
        places.append(mixed[inside].astype(np.int64))
        owners.append(owner[: len(code)][inside])
    place, own = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return place[order], np.searchsorted(own[order], np.arange(len(many)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights by name. E: word vectors (row 0: unknown), C: n-gram vectors; for each direction W, U, b (gates z, r, n)."""

    vocabulary: dict[bytes, int]
    w: dict[str, np.ndarray]
    cache: dict[bytes, int] = field(default_factory=dict, repr=False)
    table: list = field(default_factory=list, repr=False)

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        w = {"E": draw.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)), "C": draw.normal(0, 0.1, (CHAR_PLACES, CHAR_DIM))}
        for side in "fb":
            w |= {f"W{side}": draw.normal(0, d**-0.5, (d, 3 * h)), f"U{side}": draw.normal(0, h**-0.5, (h, 3 * h)), f"b{side}": np.zeros(3 * h)}
        w |= {"A": draw.normal(0, 0.3, (2 * h, h)), "v": draw.normal(0, 0.3, h), "o": draw.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
        return cls(vocabulary, {k: v.astype(np.float32) for k, v in w.items()})

    # -- forward and backward over windows: x (batch, time, d), real (batch, time) ------------------------

    def forward(self, project, real: np.ndarray, keep: bool = False):
        """Logits of windows. project(side) gives their projected inputs (batch, time, 3h). A window without words has logit c."""
        w, h = self.w, HIDDEN
        n, time = real.shape
        states, trace = np.zeros((n, time, 2 * h), np.float32), {}
        for k, side in enumerate("fb"):
            x, u = project(side), w[f"U{side}"]
            state, kept = np.zeros((n, h), np.float32), []
            for t in range(time) if side == "f" else range(time - 1, -1, -1):
                hu = state @ u[:, : 2 * h]
                gates = sigmoid(x[:, t, : 2 * h] + hu)
                z, r = gates[:, :h], gates[:, h:]
                hn = state @ u[:, 2 * h :]
                new = np.tanh(x[:, t, 2 * h :] + r * hn)
                step = (1 - z) * (new - state) * real[:, t, None]
                if keep:
                    kept.append((t, state, z, r, hn, new))
                state = state + step
                states[:, t, k * h : (k + 1) * h] = state
            trace[side] = kept
        hidden = np.tanh(states @ w["A"])
        raw = np.where(real > 0, hidden @ w["v"], -1e9)
        top = np.exp(raw - raw.max(axis=1, keepdims=True)) * real
        weights = top / np.maximum(top.sum(axis=1, keepdims=True), 1e-9)
        pooled = (weights[..., None] * states).sum(axis=1)
        logits = pooled @ w["o"] + w["c"]
        return (logits, states, hidden, weights, pooled, trace) if keep else logits

    def gradients(self, word_ids, grams, real, target, importance):
        """Loss (weighted cross-entropy) and the gradient of each weight; grams: (places, starts, inverse) of distinct words."""
        w, h = self.w, HIDDEN
        places, starts, inverse = grams
        sizes = np.diff(np.append(starts, len(places)))
        means = np.add.reduceat(w["C"][places], starts, axis=0) / sizes[:, None]
        x = np.concatenate([w["E"][word_ids], means[inverse]], axis=-1)
        logits, states, hidden, weights, pooled, trace = self.forward(lambda side: x @ w[f"W{side}"] + w[f"b{side}"], real, keep=True)
        p = sigmoid(logits)
        loss = -(importance * (target * np.log(p + 1e-9) + (1 - target) * np.log(1 - p + 1e-9))).sum()
        d_logit = (importance * (p - target)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in w.items() if k not in "EC"}
        g["o"], g["c"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * w["o"]
        d_states = weights[..., None] * d_pooled[:, None, :]
        d_weight = (states * d_pooled[:, None, :]).sum(-1)
        d_raw = weights * (d_weight - (weights * d_weight).sum(1, keepdims=True))
        g["v"] = np.tensordot(d_raw, hidden, ([0, 1], [0, 1]))
        d_pre = d_raw[..., None] * w["v"] * (1 - hidden**2)
        g["A"] = np.tensordot(states, d_pre, ([0, 1], [0, 1]))
        d_states = d_states + d_pre @ w["A"].T
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u, d_state = w[f"U{side}"], np.zeros((len(x), h), np.float32)
            for t, before, z, r, hn, new in reversed(trace[side]):
                d_state = d_state + d_states[:, t, k * h : (k + 1) * h]
                live = d_state * real[:, t, None]
                d_new = live * (1 - z) * (1 - new**2)
                d_z = -live * (new - before) * z * (1 - z)
                d_r = d_new * hn * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_new], axis=1)
                into = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"U{side}"] += before.T @ into
                g[f"W{side}"] += x[:, t].T @ d_gate
                g[f"b{side}"] += d_gate.sum(0)
                d_x[:, t] += d_gate @ w[f"W{side}"].T
                d_state = d_state - live * (1 - z) + into @ u.T
        d_x = d_x * real[..., None]
        g["E"], g["C"] = np.zeros_like(w["E"]), np.zeros_like(w["C"])
        np.add.at(g["E"], word_ids.ravel(), d_x[..., :WORD_DIM].reshape(-1, WORD_DIM))
        d_means = np.zeros_like(means)
        np.add.at(d_means, inverse.ravel(), d_x[..., WORD_DIM:].reshape(-1, CHAR_DIM))
        np.add.at(g["C"], places, np.repeat(d_means / sizes[:, None], sizes, axis=0))
        return loss, g

    # -- scoring ------------------------------------------------------------------------------------------

    def places(self, found: list[bytes]) -> np.ndarray:
        """Rows of the projections of words, which are made for new ones all at once."""
        if len(self.cache) > CACHED_WORDS:
            self.cache, self.table = {}, []
        new = list(dict.fromkeys(w for w in found if w not in self.cache))
        if new or not self.table:
            first = sum(map(len, self.table)) if self.table else 1
            if not self.table:
                self.table = [np.zeros((1, 6 * HIDDEN), np.float32)]
            for i in range(0, len(new), 50_000):
                some = new[i : i + 50_000]
                place, starts = char_grams(some)
                sizes = np.diff(np.append(starts, len(place)))
                x = np.concatenate([self.w["E"][[self.vocabulary.get(w, 0) for w in some]], np.add.reduceat(self.w["C"][place], starts, axis=0) / sizes[:, None]], axis=1)
                self.table.append(np.concatenate([x @ self.w[f"W{side}"] + self.w[f"b{side}"] for side in "fb"], axis=1).astype(np.float32))
                self.cache.update(zip(some, range(first, first + len(some)), strict=True))
                first += len(some)
            if len(self.table) > 8:
                self.table = [np.concatenate(self.table)]
        return np.fromiter(map(self.cache.__getitem__, found), np.int64, len(found))

    def window_logits(self, distinct: list[bytes], windows: Windows) -> np.ndarray:
        """Logits of windows over places in distinct words."""
        place, starts = char_grams(distinct)
        sizes = np.diff(np.append(starts, len(place)))
        x = np.concatenate([self.w["E"][[self.vocabulary.get(w, 0) for w in distinct]], np.add.reduceat(self.w["C"][place], starts, axis=0) / sizes[:, None]], axis=1)
        tables = {side: (x @ self.w[f"W{side}"] + self.w[f"b{side}"]).astype(np.float32) for side in "fb"}
        out = np.empty(len(windows.first), np.float32)
        for i in range(0, len(out), BATCH_WINDOWS):
            rows, real = windows.rows(np.arange(i, min(len(out), i + BATCH_WINDOWS)))
            out[i : i + BATCH_WINDOWS] = self.forward(lambda side, rows=rows: tables[side][rows], real)
        return out

    def score_texts(self, texts: list[bytes | None]) -> np.ndarray:
        """Scores of whole texts: the highest of their windows; the constant alone where there is no word."""
        found = [words(t) for t in texts]
        flat = [w for f in found for w in f]
        ids = self.places(flat)
        if len(self.table) > 1:
            self.table = [np.concatenate(self.table)]
        table, out = self.table[0], np.full(len(texts), -np.inf)
        starts, owner, at = [], [], 0
        ends = []
        for i, f in enumerate(found):
            cuts = window_starts(len(f))
            starts += [at + s for s in cuts]
            ends += [at + len(f)] * len(cuts)
            owner += [i] * len(cuts)
            at += len(f)
        starts, ends, owner = np.array(starts, np.int64), np.array(ends, np.int64), np.array(owner, np.int64)
        ids = np.append(ids, np.zeros(WINDOW, np.int64))
        for i in range(0, len(starts), BATCH_WINDOWS):
            s, e, o = starts[i : i + BATCH_WINDOWS], ends[i : i + BATCH_WINDOWS], owner[i : i + BATCH_WINDOWS]
            at = s[:, None] + np.arange(WINDOW)
            real = (at < e[:, None]).astype(np.float32)
            rows = np.where(real > 0, ids[np.minimum(at, len(ids) - 1)], 0)
            x = table[rows]
            logits = self.forward(lambda side, x=x: x[..., : 3 * HIDDEN] if side == "f" else x[..., 3 * HIDDEN :], real)
            np.maximum.at(out, o, logits)
        return np.where(np.isfinite(out), sigmoid(out), sigmoid(self.w["c"][0].astype(float)))


def window_starts(n: int) -> list[int]:
    """Of n words: windows every STRIDE words, until one reaches the end; none without words."""
    return [0] if 0 < n <= WINDOW else list(range(0, n - WINDOW + STRIDE, STRIDE)) if n else []


class Windows:
    """All windows of all texts, as places in one array of words; rows are made for those that are asked for."""

    def __init__(self, texts: list[np.ndarray]):
        cuts = [window_starts(len(own)) for own in texts]
        self.flat = np.concatenate([*texts, np.zeros(1, np.int32)])
        base = np.cumsum([0, *map(len, texts)])
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in cuts])
        self.first = np.array([base[i] + s for i, c in enumerate(cuts) for s in c], np.int64)
        self.stop = base[self.owner + 1]
        self.of_text = np.cumsum([0, *map(len, cuts)])

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, whether there is one) of some windows, both (windows, time)."""
        at = self.first[which][:, None] + np.arange(WINDOW)
        real = at < self.stop[which][:, None]
        return np.where(real, self.flat[np.minimum(at, len(self.flat) - 1)], 0), real.astype(np.float32)


def _numbered(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes], list[int]]:
    """The words of each text as numbers, the words by number (sorted), and in how many texts each is.

    A text's words are numbers before the next one's are found, so that a word is held once however often it stands.
    """
    number: dict[bytes, int] = {}
    ids, seen = [], Counter()
    for text in texts:
        own = words(text)
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int32, len(own)))
        seen.update(np.unique(ids[-1]).tolist())
    distinct = sorted(number)
    place = np.empty(len(number), np.int32)
    place[[number[w] for w in distinct]] = np.arange(len(number), dtype=np.int32)
    return [place[own] for own in ids], distinct, [seen[number[w]] for w in distinct]


def train(texts: list[bytes], labels: list[int], epochs: int = 12, batch: int | None = None, rate: float = 0.02, seed: int = 11) -> Network:
    """Fits a network to labels of whole texts, from some windows of each text in each epoch.

    Of texts with label 1 that is the highest window; of others the highest and OTHERS at random. At first, windows are
    ranked by the log odds of their words and n-grams under the labels, later by the network. Words lose their own vector
    at random (DROPPED), so that their characters have to tell as well. Each batch (of a sixteenth of the texts, 16 to 128
    windows) also has a window without words as one of label 0.
    """
    batch = batch or min(128, max(16, len(texts) // 16))
    draw, y = np.random.default_rng(seed), np.array(labels, np.float32)
    ids, distinct, seen = _numbered(texts)
    vocabulary = {w: i + 1 for i, w in enumerate(w for w, n in zip(distinct, seen, strict=True) if n >= LEAST_TEXTS)}
    net = Network.fresh(vocabulary)
    if not len(y) or y.min() == y.max():
        net.w["o"][:] = 0
        net.w["c"][:] = -3 if not len(y) or y.max() == 0 else 3
        return net
    places, starts = char_grams(distinct)
    bounds = np.append(starts, len(places))
    word_id = np.array([vocabulary.get(w, 0) for w in distinct], np.int64)
    odds = _log_odds(ids, y, places, bounds, len(distinct))
    inside = np.flatnonzero(word_id)
    net.w["C"][:, 0], net.w["E"][word_id[inside], 0] = odds[1] / 3, odds[0][inside] / 3
    rank = np.add.reduceat(odds[1][places], starts) / np.diff(bounds) + odds[0]
    windows = Windows(ids)
    owner, of_text = windows.owner, windows.of_text
    height = np.empty(len(owner))
    for i in range(0, len(owner), BATCH_WINDOWS):
        rows, real = windows.rows(np.arange(i, min(len(owner), i + BATCH_WINDOWS)))
        height[i : i + BATCH_WINDOWS] = np.where(real > 0, rank[rows], -np.inf).max(axis=1)
    first, second, t = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}, 0
    importance = np.where(y == 1, max(1.0, (1 - y.mean()) / y.mean() / 2), 1.0)
    trust = np.ones(len(y))
    for epoch in range(epochs):
        if epoch >= epochs // 3:
            height = net.window_logits(distinct, windows)
            trust = _trust(height, of_text, y)
        picked = []
        for i in range(len(ids)):
            if (n := of_text[i + 1] - of_text[i]) > 0:
                picked.append(of_text[i] + int(np.argmax(height[of_text[i] : of_text[i + 1]])))
                if not y[i]:
                    picked += (of_text[i] + draw.integers(n, size=min(OTHERS, n))).tolist()
        order = draw.permutation(np.array(picked, np.int64))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            shown, there = (np.concatenate([a, np.zeros((1, WINDOW), a.dtype)]) for a in windows.rows(some))
            target, weight = np.append(y[owner[some]], np.float32(0)), np.append((importance * trust)[owner[some]], 1.0)
            used, inverse = np.unique(shown, return_inverse=True)
            inverse = inverse.reshape(-1, WINDOW)
            part = np.concatenate([places[bounds[u] : bounds[u + 1]] for u in used])
            begin = np.cumsum([0, *(bounds[u + 1] - bounds[u] for u in used[:-1])])
            kept = np.where(draw.random(len(used)) < DROPPED, 0, word_id[used])
            _, g = net.gradients(kept[inverse], (part, begin, inverse), there, target, weight / len(weight))
            t += 1
            for k in net.w:
                step = g[k] + DECAY * net.w[k] * (g[k] != 0)
                first[k] = 0.9 * first[k] + 0.1 * step
                second[k] = 0.999 * second[k] + 0.001 * step**2
                net.w[k] -= (rate * (1 - epoch / (epochs + 1)) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def _trust(height: np.ndarray, of_text: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the labels: low for a label 1 if no window of its text stands above what texts with label 0 reach.

    Such a label is more likely an error than a hint, and learning it by heart makes clean texts look alike.
    """
    top = np.array([height[a:b].max() if b > a else -np.inf for a, b in zip(of_text, of_text[1:], strict=False)])
    return np.where((y == 1) & (top < np.quantile(top[y == 0], 0.98)), DOUBTED, 1.0)


def _log_odds(ids, y, places, bounds, n_words):
    """Smoothed log odds of label 1 for texts that hold each word, and each place of n-grams."""
    of_word, of_place = np.zeros((2, n_words)), np.zeros((2, CHAR_PLACES))
    for own, label in zip(ids, y.astype(int), strict=True):
        some = np.unique(own)
        of_word[label, some] += 1
        if len(some):
            of_place[label, np.unique(np.concatenate([places[bounds[u] : bounds[u + 1]] for u in some]))] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])[:, None] + 1
    return [np.log((c[1] + 0.5) / n[1]) - np.log((c[0] + 0.5) / n[0]) for c in (of_word, of_place)]


def fit(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, other: int = FIT_OTHER) -> Network:
    """Learns from the texts of docs with labels (doc_id, toxic 0/1): at most so many of each label, the first by a hash of their ids.

    Null ids, labels and texts are left out, as are labels of unknown documents and documents above FIT_BYTES; of rows with the
    same id, one counts. So what reaches the driver is bounded. Without both labels the network is a constant.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.lit("toxicity"), "doc_id").alias("h")).dropna()
    drawn = [known.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(most) for label, most in ((1, toxic), (0, other))]
    # At most toxic + other rows of three numbers, so a broadcast of bounded size; texts are not shuffled.
    few = F.broadcast(drawn[0].unionByName(drawn[1]).distinct())
    drawn = docs.where(F.octet_length("text") <= FIT_BYTES).select("doc_id", "text").join(few, "doc_id").groupBy("h", "doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(drawn.collect(), key=lambda r: (r["h"], r["doc_id"], r["toxic"]))
    texts, toxicities = [r["text"].encode() for r in rows], [r["toxic"] for r in rows]
    del rows
    return train(texts, toxicities)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of each row of (doc_id, text), other columns aside.

    Null and wordless texts get the network's constant. All windows of a long text are scored. Repeated rows repeat, and an
    empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def batch(rows: pa.RecordBatch) -> dict:
        own, texts, scores = shared.value, rows.column("text").cast(pa.binary()).to_pylist(), []
        for i in range(0, len(texts), 200):
            scores.append(own.score_texts(texts[i : i + 200]))
        return {"doc_id": rows.column("doc_id"), "score": np.concatenate(scores) if scores else []}

    return map_batches(docs.select("doc_id", "text"), batch, "doc_id long, score double")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels (doc_id, toxic) where crc32(doc_id) modulo 5 is not 0; scores every row of docs."""
    fold = bucket_of(F.col("doc_id"), 5)
    known = labels.where(fold != 0).select("doc_id", "toxic")
    net = fit(docs, known)
    return score(docs, net).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
