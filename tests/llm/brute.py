"""Plain versions of the operators, for comparison; one text or one table at a time, no Spark."""

import hashlib
import math
import re
import unicodedata
from itertools import combinations

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

from sheaf.llm.bpe import load_ranks

RANKS = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def bpe(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


def split_blank(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text):
    w = split_blank(ascii_lower(text))
    if not w:
        return 0
    n = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (hex, component)}."""
    prints = {d: simhash(t) for d, t in rows}
    distinct = sorted(set(prints.values()))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for d, f in prints.items():
        least[find(f)] = min(d, least.get(find(f), d))
    return {d: (f"{f:016x}", least[find(f)]) for d, f in prints.items()}


def test_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def contamination(docs, items, window=10):
    phrases = {}
    for item, text in items:
        w = test_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = sorted({len(p) for p in phrases})
    out = []
    for doc, text in docs:
        w, hit, found = test_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[p]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(str(x) for x in found if x is not None)).encode()), bool(hit)))
    return out


def proximity(docs, items, window=10, span=20):
    """{(place of the document, item): number of places}."""
    phrases = {}
    for item, text in items:
        w = test_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    held = {}
    for p in phrases:
        for w in set(p):
            held[w] = held.get(w, 0) + 1
    out = {}
    for n, (_, text) in enumerate(docs):
        w = test_words(text)
        for p, owners in phrases.items():
            key = min(p, key=lambda x: (held[x], x.encode()))
            for i, x in enumerate(w):
                if x == key and set(p) <= set(w[max(0, i - span) : i + span + 1]):
                    for item in owners:
                        out.setdefault((n, item), set()).add(i)
    return {k: len(v) for k, v in out.items()}


def line_dedup(rows, ratio=0.05):
    """rows: (host, text) -> [(text, lines, dropped)]."""
    pages, holding = {}, {}
    for host, text in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip("\x20\x09\x0a\x0b\x0c\x0d") for x in (text or "").split("\n")} - {""}:
            holding[host, line] = holding.get((host, line), 0) + 1
    bad = {k for k, n in holding.items() if n > 1 and n > ratio * pages[k[0]]}
    out = []
    for host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if (host, x.strip("\x20\x09\x0a\x0b\x0c\x0d")) not in bad]
        out.append((None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def quality(text):
    text = text or ""
    w = split_blank(text)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeat = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if split_blank(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), n < 50 or 100 * len(repeat) > 50 * n


def quality_vector(text):
    n, chars, symbols, lines, repeats, _ = quality(text)
    w = max(n, 1)
    return [math.log1p(n), chars / w, *(math.log1p(100 * c / w) for c in (symbols, lines, repeats))]


def mcd(x, half, floor, consistency, first, more, bins):
    """Location and scatter of the rows of x, by plain concentration steps from three starts."""
    target, n = np.diag(np.square(floor)), len(x)
    middle = lambda a: np.sort(a, axis=0)[(n - 1) // 2]  # noqa: E731  as approximate percentiles take it: an element
    center = middle(x)
    width = np.sqrt((1.4826 * middle(abs(x - center))) ** 2 + np.square(floor))
    z = (x - center) / width
    long = np.linalg.norm(z, axis=1, keepdims=True)
    signs = z / np.where(long > 0, long, 1)

    def correlation(m):
        scale = np.sqrt(np.outer(np.diag(m), np.diag(m)))
        out = 0.99 * np.where(scale > 1e-12, m / np.where(scale > 1e-12, scale, 1), 0)
        np.fill_diagonal(out, 1)
        return out

    def step(m, s):
        far = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
        place = np.floor(bins * np.log2(far + 1))
        near = x[place <= np.sort(place)[math.ceil(half * n) - 1]]
        return near.mean(0), consistency * np.cov(near.T, bias=True) + target

    found = []
    for c in (np.eye(5), correlation(np.cov(np.tanh(z).T, bias=True)), correlation(signs.T @ signs / n)):
        m, s = center, c * np.outer(width, width)
        for _ in range(first):
            m, s = step(m, s)
        found.append((round(np.linalg.slogdet(s)[1], 9), len(found), m, s))
    _, _, m, s = min(found, key=lambda e: e[:2])
    for _ in range(more):
        m, s = step(m, s)
    return m, s


def quality_distances(rows, least, **how):
    """rows: (text, lang, source) -> d2 of each, and whether the base rules fail it."""
    x = np.array([quality_vector(t) for t, _, _ in rows])
    failed = np.array([quality(t)[5] for t, _, _ in rows])
    own, of_lang = [(l, s) for _, l, s in rows], [l for _, l, _ in rows]
    members = lambda names, name: np.array([n == name for n in names]) & ~failed
    out, fitted = np.zeros(len(rows)), {}
    for i in range(len(rows)):
        for key, inside in ((("own", own[i]), lambda i=i: members(own, own[i])), (("lang", of_lang[i]), lambda i=i: members(of_lang, of_lang[i])), (("all",), lambda: ~failed)):
            if key not in fitted:
                where = inside()
                fitted[key] = mcd(x[where], **how) if where.sum() >= least or key == ("all",) else None
            if fitted[key]:
                m, s = fitted[key]
                out[i] = (x[i] - m) @ np.linalg.inv(s) @ (x[i] - m)
                break
    return out, failed


def secret_spans(text):
    """The base spans by hand, letter by letter: (start, end, kind), by start and then kind."""
    text = text or ""
    fold = ascii_lower(text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    out, i = [], 0

    def skip(at, letters, most):
        n = 0
        while at < len(text) and text[at] in letters and n < most:
            at, n = at + 1, n + 1
        return at

    def assign(at):
        """(end, length of the value), trying the optional parts as a matcher does: taken first, left out if that fails."""
        for cue in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not fold.startswith(cue, at):
                continue
            after = at + len(cue)
            for quoted in sorted({skip(after, "\"'", 1), after}, reverse=True):
                mark = skip(quoted, " ", len(text))
                if mark < len(text) and text[mark] in ":=":
                    begin = skip(mark + 1, " ", len(text))
                    begin = skip(begin, "\"'", 1)
                    end = skip(begin, value, len(text))
                    if end > begin:
                        return end, end - begin
        return None

    while i < len(text):
        found = assign(i)
        if found:
            if found[1] >= 6:
                out.append((i, found[0], "assign"))
            i = found[0]
        else:
            i += 1
    for kind, head, letters, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            end = skip(i + len(head), letters, len(text))
            if text.startswith(head, i) and end > i + len(head):
                if end - i >= least:
                    out.append((i, end, kind))
                i = end
            else:
                i += 1
    return sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[2])))


def letters(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def language_model(rows, smooth=0.5):
    """rows: (lang, text) -> a function from text to (language, share), with one dictionary of counts for each kind of unit."""
    langs = sorted({lang for lang, _ in rows})
    parts = lambda w, n: [w] if n == 0 else [x[i : i + n] for x in ["<" + w + ">" if n > 1 else w] for i in range(len(x) - n + 1)]
    counts = {(n, lang): {} for n in range(5) for lang in langs}
    for lang, text in rows:
        for w in letters(text):
            for n in range(5):
                for u in parts(w, n):
                    counts[n, lang][u] = counts[n, lang].get(u, 0) + 1
    known = {n: {u for lang in langs for u in counts[n, lang]} for n in range(5)}
    totals = {k: sum(v.values()) for k, v in counts.items()}

    def log(n, lang, u):
        return math.log(counts[n, lang].get(u, 0) + smooth) - math.log(totals[n, lang] + smooth * len(known[n]))

    def predict(text):
        total = dict.fromkeys(langs, 0.0)
        if not letters(text) or not langs:
            return "und", 0.0
        for w in letters(text):
            for n in (0, 4, 3, 2, 1):
                units = [u for u in parts(w, n) if u in known[n]]
                if units:
                    for lang in langs:
                        total[lang] += sum(log(n, lang, u) for u in units) / len(units)
                    break
        best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
        return best, 1 / sum(math.exp(t - total[best]) for t in total.values())

    return predict
