"""Secret scans: patterns, and a linear-chain conditional random field over tokens for what they miss.

The field tags tokens B (a secret begins), I (goes on) or O. Its features are a token's class (a word that announces
secrets, or length, kinds of characters and spread), the classes of the two tokens before and of the one after, and
features of the file. It is fitted by gradient ascent on sentences around the base spans of a bounded sample, their
tokens being the labels, and decoded by Viterbi's algorithm. So that it finds what the patterns don't, it also learns
from the sentences with the announcing word hidden or replaced by another, and with the value replaced by one of another
shape: neither is needed, if the rest tells.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import map_batches

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of fewer fails as a whole, wherever in it one begins
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_DIGITS, _HEX_RUN = bytes(120 if b in b"0123456789abcdef" else 32 for b in range(256)), b"x" * 24
_TOKEN = re.compile(r"[\w+/.-]+|[^\w\s]")
#: The words that the class of a token keeps as they are.
_CUES = frozenset("password passwd secret token key apikey api_key pwd auth bearer credential credentials private access login user".split())

#: Bounds of the fit: documents with a base span, documents without, bytes of a document that is learned from, tokens on
#: either side of a span, and sentences of a document.
FIT_WITH, FIT_WITHOUT, FIT_BYTES, AROUND, SENTENCES = 400, 400, 1 << 16, 12, 4
#: Rounds of changed sentences where there are few to learn from.
MOST_ROUNDS = 12
#: The alphabets of the values that are put in for others, and their least and greatest length.
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_VALUE_LENGTHS = (16, 64)
#: Marks that stand between an announcing word and a value, and words that announce nothing, put in for them.
_PARTING = ("=", ":", '"', "'", ",", ">")
_PLAIN_WORDS = ("to", "the", "with", "nothing", "interesting", "And", ".")
#: Distinct tokens whose classes a Python worker keeps before it starts afresh.
CACHED_TOKENS = 150_000
_B, _I, _O = 0, 1, 2
_NEVER = -1e4


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value), by start and then kind; ends exclusive, in code points.

    A pattern is run where a plain search finds what all of its matches hold.
    """
    found = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text)]
    if _HEX_RUN in text.encode().translate(_HEX_DIGITS):
        found += [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def span_list(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(((s[0], s[1], s[2]) for s in spans), key=lambda s: (s[0], KINDS.index(s[2]))))


def token_class(token: str) -> str:
    """The token itself if a cue or a mark; else its length, its kinds of characters and how many differ."""
    low = token.lower()
    if low in _CUES or (len(token) == 1 and not token.isalnum()):
        return low
    if token.isalpha() and token.isascii():  # most tokens: what follows, for letters only
        cases = "10" if token.islower() else "01" if token.isupper() else "11"
        return f"{min(len(token).bit_length(), 8)}{cases}00000"
    kinds = (any("a" <= c <= "z" for c in token), any("A" <= c <= "Z" for c in token), any("0" <= c <= "9" for c in token), any(c in "+/_.-" for c in token), not token.isascii())
    size = min(len(token).bit_length(), 8)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    mixed = 0 if changes < 2 else 1 if changes < 5 else 2
    hexadecimal = bool(re.fullmatch(r"[0-9a-fA-F]+", token)) and any(c.isdigit() for c in token)
    return f"{size}{''.join('01'[k] for k in kinds)}{mixed}{int(hexadecimal)}"


def file_class(text: str) -> int:
    """How much of the file is digits and how much marks of code, in thirds: one of nine."""
    n = max(len(text), 1)
    digits = sum(map(text.count, "0123456789")) / n
    marks = sum(map(text.count, "{}();=<>[]")) / n
    return 3 * ((digits > 0.01) + (digits > 0.05)) + (marks > 0.005) + (marks > 0.03)


class _Classes(dict):
    """Tokens to the numbers of their classes, found out when first asked for."""

    def __init__(self, classes: dict[str, int]):
        super().__init__()
        self.classes = classes

    def __missing__(self, token: str) -> int:
        number = self[token] = self.classes.get(token_class(token), 0)
        return number


@dataclass
class Field:
    """A fitted field: weights by class and label. Class 0 stands for unknown ones and for what lies beyond the ends."""

    classes: dict[str, int]
    own: np.ndarray
    back1: np.ndarray
    back2: np.ndarray
    ahead: np.ndarray
    file: np.ndarray
    move: np.ndarray
    cache: _Classes | None = field(default=None, repr=False)

    def ids(self, tokens: list[str]) -> np.ndarray:
        if self.cache is None or len(self.cache) > CACHED_TOKENS:
            self.cache = _Classes(self.classes)
        return np.fromiter(map(self.cache.__getitem__, tokens), np.int64, len(tokens))

    def emissions(self, ids: np.ndarray, kind: int) -> np.ndarray:
        out = self.own[ids] + self.file[kind]
        out[1:] += self.back1[ids[:-1]]
        out[2:] += self.back2[ids[:-2]]
        out[:-1] += self.ahead[ids[1:]]
        return out

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Viterbi, only where a secret can gain on O.

        A run B I I ... gains on all O at most the sum of its tokens' bounds, so a token in no interval of positive sum is O.
        """
        m, labels = self.move, np.full(len(e), _O)
        if not len(e):
            return labels
        gain_b = max(0.0, m[:, _B].max() - m[_O, _O]) + max(0.0, m[:, _O].max() - m[_O, _O])
        gain_i = max(0.0, m[:2, _I].max() - m[_O, _O])
        bound = np.maximum(e[:, _B] - e[:, _O] + gain_b, e[:, _I] - e[:, _O] + gain_i)
        if bound.max() <= 0:
            return labels
        sums = np.concatenate(([0.0], np.cumsum(bound)))
        ahead = np.maximum.accumulate(sums[:0:-1])[::-1]
        able = np.concatenate(([False], ahead - np.minimum.accumulate(sums[:-1]) > 0, [False]))
        edges = np.flatnonzero(able[1:] != able[:-1]).reshape(-1, 2)
        for first, stop in edges.tolist():
            labels[first:stop] = self._stretch(e[first:stop].tolist(), first == 0, stop == len(e))
        return labels

    def _stretch(self, rows: list, opens: bool, ends: bool) -> list[int]:
        """The best labels of some tokens that stand between O, or at the ends of the text."""
        moves, back = self.move.tolist(), []
        now = [rows[0][_B], _NEVER, rows[0][_O]] if opens else [moves[_O][b] + rows[0][b] for b in range(3)]
        for row in rows[1:]:
            best = [max(range(3), key=lambda a, b=b: now[a] + moves[a][b]) for b in range(3)]
            now = [now[best[b]] + moves[best[b]][b] + row[b] for b in range(3)]
            back.append(best)
        label = max(range(3), key=lambda a: now[a] + (0.0 if ends else moves[a][_O]))
        out = [label]
        for best in reversed(back):
            label = best[label]
            out.append(label)
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        tokens = _TOKEN.findall(text)
        if not tokens:
            return []
        labels = self.decode(self.emissions(self.ids(tokens), file_class(text)))
        if not (labels == _B).any():
            return []
        out: list[tuple[int, int, str]] = []
        for m, label in zip(_TOKEN.finditer(text), labels.tolist(), strict=True):
            if label == _B:
                out.append((m.start(), m.end(), "crf"))
            elif label == _I and out:
                out[-1] = (out[-1][0], m.end(), "crf")
        return out


def labelled_tokens(text: str) -> tuple[list[str], list[int]]:
    values = [(s[3], s[1]) for s in base_spans(text)]
    tokens, labels, last = [], [], None
    for m in _TOKEN.finditer(text):
        inside = next((v for v in values if v[0] < m.end() and m.start() < v[1]), None)
        tokens.append(m[0])
        labels.append(_O if inside is None else _I if last is not None and last[0] < inside[1] and inside[0] < last[1] else _B)
        last = inside
    return tokens, labels


def _sentences(text: str, draw: np.random.Generator, rounds: int = 1):
    """(classes, labels) of the tokens around some base spans, or around tokens with digits where there is none; and changed ones, in so many rounds."""
    tokens, labels = labelled_tokens(text)
    if not tokens:
        return
    begins = [i for i, x in enumerate(labels) if x == _B]
    places = begins or [i for i, t in enumerate(tokens) if any(c.isdigit() for c in t)]
    places = sorted(draw.choice(places, min(SENTENCES, len(places)), replace=False).tolist()) if places else [len(tokens) // 2]
    cues = sorted(_CUES)
    for p in places:
        first, stop = max(0, p - AROUND), p + AROUND
        classes, marks = [token_class(t) for t in tokens[first:stop]], labels[first:stop]
        yield classes, marks
        if not begins:
            continue
        announced = [i for i, t in enumerate(tokens[first:stop]) if t.lower() in _CUES and marks[i] == _O]
        values = [i for i, x in enumerate(marks) if x == _B]
        parts = [i for v in values for i in range(max(0, v - 3), min(len(marks), v + 2)) if classes[i] in _PARTING]

        def shaped() -> str:
            alphabet = _ALPHABETS[draw.integers(len(_ALPHABETS))]
            return token_class("".join(alphabet[k] for k in draw.integers(len(alphabet), size=draw.integers(*_VALUE_LENGTHS))))

        def changed(at: list[int], to) -> list[str]:
            return [to() if i in at else c for i, c in enumerate(classes)]

        for _ in range(rounds):
            yield changed(announced, str), marks  # the value's shape and the marks tell
            yield [shaped() if i in values else c for i, c in enumerate(changed(announced + parts, lambda: token_class(_PLAIN_WORDS[draw.integers(len(_PLAIN_WORDS))])))], marks  # its shape alone
            if announced:  # another word and other marks announce a value of another shape
                other = changed(parts, lambda: _PARTING[draw.integers(len(_PARTING))])
                yield [shaped() if i in values else cues[draw.integers(len(cues))] if i in announced else c for i, c in enumerate(other)], marks


def train(texts: list[str], steps: int = 120, rate: float = 0.15, decay: float = 1e-3, seed: int = 5) -> Field:
    """Maximises the labels' log likelihood, less decay times the squared weights, over sentences of the texts."""
    width, draw = 2 * AROUND, np.random.default_rng(seed)
    rounds = min(MOST_ROUNDS, 1 + FIT_WITH // (1 + sum(bool(base_spans(text)) for text in texts)))
    cut = [(classes, labels, file_class(text)) for text in texts for classes, labels in _sentences(text, draw, rounds)]
    names: dict[str, int] = {}
    # A hidden class is numbered as unknown ones are, so the field learns what to make of these.
    rows = [[names.setdefault(c, len(names) + 1) if c else 0 for c in classes] for classes, _, _ in cut]
    k, n = len(names) + 1, len(cut)
    shape = {"own": (k, 3), "back1": (k, 3), "back2": (k, 3), "ahead": (k, 3), "file": (9, 3), "move": (3, 3)}
    w = {name: np.zeros(s) for name, s in shape.items()}
    forbidden = np.zeros((3, 3))
    forbidden[_O, _I] = _NEVER
    if not n:
        return Field({}, w["own"], w["back1"], w["back2"], w["ahead"], w["file"], w["move"] + forbidden)
    ids, gold, real = np.zeros((n, width), np.int64), np.full((n, width), _O), np.zeros((n, width), bool)
    for i, (row, (_, labels, _)) in enumerate(zip(rows, cut, strict=True)):
        ids[i, : len(row)], gold[i, : len(row)], real[i, : len(row)] = row, labels, True
    kinds = np.array([c[2] for c in cut])
    shifted = {"own": ids, "back1": np.pad(ids, ((0, 0), (1, 0)))[:, :-1], "back2": np.pad(ids, ((0, 0), (2, 0)))[:, :-2], "ahead": np.pad(ids, ((0, 0), (0, 1)))[:, 1:]}
    hot = np.eye(3)[gold] * real[..., None]
    step_real = real[:, 1:]
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (gold[:, :-1][step_real], gold[:, 1:][step_real]), 1)
    first, second = {x: np.zeros(s) for x, s in shape.items()}, {x: np.zeros(s) for x, s in shape.items()}
    start = np.array([0.0, _NEVER, 0.0])

    def total(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for t in range(1, steps + 1):
        e = sum(w[x][shifted[x]] for x in ("own", "back1", "back2", "ahead")) + w["file"][kinds][:, None, :]
        e = e * real[..., None]
        m = w["move"] + forbidden
        alpha, beta = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        alpha[:, 0] = e[:, 0] + start
        for i in range(1, width):
            on = alpha[:, i - 1, :, None] + m + e[:, i, None, :]
            alpha[:, i] = np.where(real[:, i, None], total(on, 1), alpha[:, i - 1])
        for i in range(width - 2, -1, -1):
            on = m + (e[:, i + 1] + beta[:, i + 1])[:, None, :]
            beta[:, i] = np.where(real[:, i + 1, None], total(on, 2), 0.0)
        z = total(alpha[:, -1], 1)
        each = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        both = alpha[:, :-1, :, None] + m + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
        moves = (np.exp(np.minimum(both, 0)) * step_real[..., None, None]).sum(axis=(0, 1))
        grad = {x: np.zeros(s) for x, s in shape.items()}
        for x in ("own", "back1", "back2", "ahead"):
            np.add.at(grad[x], shifted[x].ravel(), (hot - each).reshape(-1, 3))
        np.add.at(grad["file"], kinds, (hot - each).sum(axis=1))
        grad["move"] = gold_moves - moves
        for x in shape:
            g = grad[x] / n - decay * w[x]
            first[x] = 0.9 * first[x] + 0.1 * g
            second[x] = 0.99 * second[x] + 0.01 * g * g
            w[x] = w[x] + rate * (first[x] / (1 - 0.9**t)) / (np.sqrt(second[x] / (1 - 0.99**t)) + 1e-6)
    return Field(names, w["own"], w["back1"], w["back2"], w["ahead"], w["file"], w["move"] + forbidden)


def fit(docs: DataFrame, with_spans: int = FIT_WITH, without: int = FIT_WITHOUT) -> Field:
    """A field from at most with_spans documents of base spans and without others, the first by a hash of their ids.

    Documents above FIT_BYTES aren't learned from (they are scanned as all are). Of rows with the same id, one counts, and
    null ids and texts are left out; so what reaches the driver is bounded. Without base spans the field finds nothing.
    """
    likely = F.col("text").rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]")
    drawn = docs.where(F.octet_length("text") <= FIT_BYTES).select("doc_id", "text", F.xxhash64(F.lit("secrets"), "doc_id").alias("h"))
    first = lambda rows, n: rows.select("doc_id", "h").where("doc_id is not null").orderBy("h", "doc_id").limit(n)
    # At most with_spans + without ids: a broadcast of bounded size.
    few = F.broadcast(first(drawn.where(likely), with_spans).unionByName(first(drawn, without)).distinct())
    rows = drawn.drop("h").join(few, "doc_id").groupBy("h", "doc_id").agg(F.min("text").alias("text")).collect()
    return train([r["text"] for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"]))])


def scan(docs: DataFrame, model: Field) -> DataFrame:
    """The spans of each row of (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A span of the field is added unless it lies within a base span, so it may also show that a secret goes on beyond one;
    base spans all stay. A null text is empty: no spans. A row in gives a row out, so repeated rows repeat and an empty
    table gives none; other columns are ignored; texts are scanned whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(rows: pa.RecordBatch) -> dict:
        own, out = shared.value, {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in rows.column("text").to_pylist():
            base = base_spans(text or "")
            more = [s for s in own.spans(text or "") if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(span_list(base).encode()).hexdigest())
            out["spans"].append(span_list([*base, *more]))
        return out | {"doc_id": rows.column("doc_id")}

    return map_batches(docs.select("doc_id", "text"), batch, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
