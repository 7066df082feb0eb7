"""One document: cross-references, recovery, lazy objects, edits, pages and the ways to save."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from sheaf.functions import codecs
from sheaf.sources.syntax import Fault, Name, Reader, Ref, Stream, Token, format_indirect, format_value, references, remapped

# Fixed limits.
TREE_DEPTH = 64
CHAIN_HOPS = 100
DEFAULT_MEDIA = [0.0, 0.0, 612.0, 792.0]
_HEADER = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")


class Entry(NamedTuple):
    """Where an object is: kind 0 free, 1 at an offset (place, generation), 2 in an object stream (its number, index)."""

    kind: int
    place: int
    extra: int


def last_startxref(data: bytes) -> int:
    at = data.rfind(b"startxref")
    if at < 0:
        raise Fault("xref", "no startxref")
    offset = Reader(data, at + 9).value()
    if type(offset) is not int:
        raise Fault("xref", "startxref without an offset", at)
    return offset


def classic_section(data: bytes, at: int) -> tuple[dict[int, Entry], dict]:
    """A table of subsections and its trailer."""
    reader, entries = Reader(data, at), {}
    if not reader.word(b"xref"):
        raise Fault("xref", "no table here", at)
    while not reader.word(b"trailer"):
        first, count = reader.value(), reader.value()
        if type(first) is not int or type(count) is not int or not 0 <= count <= len(data):
            raise Fault("xref", "a broken subsection", reader.at)
        for i in range(count):
            offset, generation, kind = reader.value(), reader.value(), reader.value()
            if type(offset) is not int or type(generation) is not int or not isinstance(kind, Token):
                raise Fault("xref", "a broken entry", reader.at)
            entries.setdefault(first + i, Entry(1, offset, generation) if kind.word == b"n" else Entry(0, offset, generation))
    trailer = reader.value()
    if not isinstance(trailer, dict):
        raise Fault("xref", "no trailer", reader.at)
    return entries, trailer


def stream_section(data: bytes, at: int) -> tuple[dict[int, Entry], dict]:
    """A cross-reference stream: fields of /W bytes, a type of no width is 1, unknown types are passed over."""
    _, stream = Reader(data, at).indirect()
    if not isinstance(stream, Stream) or stream.entries.get("Type") != "XRef":
        raise Fault("xref", "no cross-reference stream here", at)
    body, _ = codecs.decode(stream.raw, codecs.chain_of(stream.entries))
    widths = stream.entries.get("W")
    if not isinstance(widths, list) or len(widths) < 3 or not all(type(w) is int and 0 <= w <= 8 for w in widths):
        raise Fault("xref", "no widths", at)
    index = stream.entries.get("Index") or [0, stream.entries.get("Size", 0)]
    entries, place, step = {}, 0, sum(widths[:3])
    for first, count in zip(index[::2], index[1::2], strict=False):
        for number in range(first, first + count):
            row = body[place : place + step]
            if len(row) < step or not step:
                break
            place += step
            a, b = widths[0], widths[0] + widths[1]
            kind = int.from_bytes(row[:a], "big") if a else 1
            if kind <= 2:
                entries.setdefault(number, Entry(kind, int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:step], "big")))
    return entries, stream.entries


def sections(data: bytes) -> Iterator[tuple[int, dict[int, Entry], dict]]:
    """(sequence, entries, trailer) from the newest section on: a hybrid's stream before the older ones; no section twice."""
    waiting, seen, sequence = [last_startxref(data)], set(), 0
    while waiting:
        at = waiting.pop(0)
        if at in seen or not 0 <= at < len(data):
            if not sequence:
                raise Fault("xref", "startxref points nowhere", at)
            continue
        seen.add(at)
        classic = data.startswith(b"xref", Reader(data, at).skip())
        entries, trailer = (classic_section if classic else stream_section)(data, at)
        yield sequence, entries, trailer
        sequence += 1
        more = [trailer[k] for k in ("XRefStm", "Prev") if type(trailer.get(k)) is int and (k == "Prev" or classic)]
        waiting = more + waiting


def load_xref(data: bytes) -> tuple[dict[int, Entry], dict]:
    """Newest wins, for entries and for the trailer's keys."""
    entries: dict[int, Entry] = {}
    trailer: dict = {}
    for _, own, more in sections(data):
        entries = own | entries
        trailer = more | trailer
    return entries, trailer


def rebuild_xref(data: bytes) -> tuple[dict[int, Entry], dict]:
    """From every `N G obj` in the bytes, the last of a number counting; the trailer from the newest one, or the Catalog."""
    entries = {int(m[1]): Entry(1, m.start(), int(m[2])) for m in _OBJECT.finditer(data)}
    if not entries:
        raise Fault("malformed", "no object in the file")
    trailer: dict = {}
    at = len(data)
    while not trailer and (at := data.rfind(b"trailer", 0, at)) >= 0:
        try:
            found = Reader(data, at + 7).value()
            trailer = found if isinstance(found, dict) and "Root" in found else {}
        except Fault:
            pass
    if "Root" not in trailer:
        for number, entry in sorted(entries.items(), key=lambda e: -e[1].place):
            try:
                ref, value = Reader(data, entry.place).indirect()
            except Fault:
                continue
            if isinstance(value, Stream) and value.entries.get("Type") == "XRef" and isinstance(value.entries.get("Root"), Ref):
                trailer = {k: v for k, v in value.entries.items() if k in ("Root", "Info", "ID", "Encrypt")} | trailer
            elif isinstance(value, dict) and value.get("Type") == "Catalog":
                trailer.setdefault("Root", Ref(number, entry.extra))
                break
    if "Root" not in trailer:
        raise Fault("malformed", "no catalog in the file")
    return entries, trailer | {"Size": max(entries) + 1}


class Document:
    """An object graph over bytes, with edits on top: deleted before edited before stored."""

    def __init__(self, data: bytes = b"", password: str | bytes | None = None, allow_encrypted: bool = False):
        self.data, self.entries, self.trailer, self.repaired = data, {}, {}, False
        self.cache: dict[int, object] = {}
        self.edits: dict[int, object] = {}
        self.deleted: set[int] = set()
        self.members: dict[int, dict[int, object]] = {}
        self.security = None
        self.policy_changed = False
        self.highest: int | None = None
        if data:
            try:
                self.entries, self.trailer = load_xref(data)
                if not isinstance(self.trailer.get("Root"), Ref):
                    raise Fault("xref", "no root")
            except Fault:
                self.entries, self.trailer = rebuild_xref(data)
                self.repaired = True
            if "Encrypt" in self.trailer and not allow_encrypted:
                from sheaf.functions import crypto

                self.security = crypto.unlock(self, password if password is not None else b"")
        else:
            pages = self.add({"Type": Name("Pages"), "Kids": [], "Count": 0})
            self.trailer = {"Root": self.add({"Type": Name("Catalog"), "Pages": pages})}

    # -- objects ---------------------------------------------------------------------------------------

    def get(self, number: int):
        """The object of a number; null if dangling, deleted or unreadable. Generations aren't compared."""
        if number in self.deleted:
            return None
        if number in self.edits:
            return self.edits[number]
        if number not in self.cache:
            self.cache[number] = None  # a stream whose length points to itself
            self.cache[number] = self._load(number)
        return self.cache[number]

    def _load(self, number: int):
        entry = self.entries.get(number)
        if entry is None or entry.kind == 0:
            return None
        try:
            if entry.kind == 2:
                return self._in_stream(entry.place).get(number)
            ref, value = Reader(self.data, entry.place).indirect(lambda r: self.resolve(r))
            if ref.number != number:
                return None
            return self.security.decrypt(ref, value) if self.security else value
        except Fault:
            return None

    def _in_stream(self, number: int) -> dict[int, object]:
        """The members of an object stream; those that can't be read are left out."""
        if number not in self.members:
            self.members[number] = {}
            stream = self.get(number)
            if isinstance(stream, Stream):
                body, reader = self.decoded(stream), None
                reader = Reader(body)
                n, first = self.resolve(stream.entries.get("N")), self.resolve(stream.entries.get("First"))
                if type(n) is int and type(first) is int:
                    pairs = [(reader.value(), reader.value()) for _ in range(min(n, len(body)))]
                    for name, offset in pairs:
                        try:
                            value = Reader(body, first + offset).value()
                            if not isinstance(value, Token):
                                self.members[number][name] = value
                        except (Fault, TypeError):
                            continue
        return self.members[number]

    def resolve(self, value):
        """What a chain of references leads to."""
        for _ in range(CHAIN_HOPS):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.number)
        return None

    def dictionary(self, value) -> dict:
        """The entries of a dictionary or stream, resolved; empty for anything else."""
        value = self.resolve(value)
        return value.entries if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    def array(self, value) -> list:
        value = self.resolve(value)
        return value if isinstance(value, list) else []

    def number(self, value) -> float | None:
        value = self.resolve(value)
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None

    def numbers(self) -> list[int]:
        """Of all objects: stored in use or edited, less the deleted."""
        return sorted(({n for n, e in self.entries.items() if e.kind} | set(self.edits)) - self.deleted)

    def chain(self, entries: dict) -> list[tuple[str, dict]]:
        keys = {k: self.resolve(entries[k]) for k in ("Filter", "F", "DecodeParms", "DP") if k in entries}
        flat = {k: [self.resolve(x) for x in v] if isinstance(v, list) else v for k, v in keys.items()}
        return codecs.chain_of(flat)

    def decoded(self, stream: Stream) -> bytes:
        data, codec = codecs.decode(stream.raw, self.chain(stream.entries))
        if codec:
            raise Fault("unsupportedFeature", codec)
        return data

    # -- edits -----------------------------------------------------------------------------------------

    def add(self, value) -> Ref:
        if self.highest is None:
            size = self.trailer.get("Size")
            self.highest = max([0, *self.entries, *self.edits, *self.deleted, size - 1 if type(size) is int else 0])
        self.highest += 1
        self.edits[self.highest] = value
        return Ref(self.highest, 0)

    def set(self, ref: Ref, value) -> None:
        self.deleted.discard(ref.number)
        self.edits[ref.number] = value

    def update(self, ref: Ref, **entries) -> None:
        """Sets keys of a dictionary or stream; None removes."""
        old = self.get(ref.number)
        new = {k: v for k, v in {**self.dictionary(ref), **entries}.items() if v is not None}
        self.set(ref, Stream(new, old.raw) if isinstance(old, Stream) else new)

    def delete(self, ref: Ref) -> None:
        self.edits.pop(ref.number, None)
        self.deleted.add(ref.number)

    # -- pages -----------------------------------------------------------------------------------------

    @property
    def catalog(self) -> dict:
        return self.dictionary(self.trailer.get("Root"))

    def page_count(self) -> int:
        """As declared: /Count of the root node, not the number of leaves."""
        count = self.dictionary(self.catalog.get("Pages")).get("Count")
        return count if type(count) is int else 0

    def page_refs(self) -> list[Ref]:
        """The leaves in order; kids that aren't references are passed over, as are nodes met before."""
        out, seen = [], set()

        def walk(ref, depth: int):
            if depth > TREE_DEPTH or not isinstance(ref, Ref) or ref.number in seen:
                return
            seen.add(ref.number)
            node = self.dictionary(ref)
            if "Kids" in node:
                for kid in self.array(node["Kids"]):
                    walk(kid, depth + 1)
            elif node:
                out.append(ref)

        walk(self.catalog.get("Pages"), 0)
        return out

    def inherited(self, node: dict, key: str):
        """The value of the node or its nearest ancestor that has it."""
        for _ in range(TREE_DEPTH):
            if key in node:
                return self.resolve(node[key])
            if "Parent" not in node:
                return None
            node = self.dictionary(node["Parent"])
        return None

    def attributes(self, page: dict) -> dict:
        media = self.rectangle(self.inherited(page, "MediaBox")) or DEFAULT_MEDIA
        crop = self.rectangle(self.inherited(page, "CropBox"))
        if crop:
            crop = [max(crop[0], media[0]), max(crop[1], media[1]), min(crop[2], media[2]), min(crop[3], media[3])]
        if not crop or crop[2] <= crop[0] or crop[3] <= crop[1]:
            crop = media
        rotate = int(self.number(self.inherited(page, "Rotate")) or 0) % 360
        return {"media": media, "crop": crop, "rotate": rotate if rotate % 90 == 0 else 0, "resources": self.dictionary(self.inherited(page, "Resources"))}

    def rectangle(self, value) -> list[float] | None:
        """Of four numbers, with corners in order."""
        n = [self.number(x) for x in self.array(value)]
        if len(n) < 4 or None in n[:4]:
            return None
        return [min(n[0], n[2]), min(n[1], n[3]), max(n[0], n[2]), max(n[1], n[3])]

    def content(self, page: dict, tolerant: bool = True) -> bytes:
        """The page's content streams joined by line feeds; a tolerant reader passes over broken ones."""
        value = self.resolve(page.get("Contents"))
        parts = []
        for part in value if isinstance(value, list) else [value]:
            stream = self.resolve(part)
            if not isinstance(stream, Stream):
                continue
            try:
                parts.append(self.decoded(stream))
            except Fault:
                if not tolerant:
                    raise
        return b"\n".join(parts)

    # -- saving ----------------------------------------------------------------------------------------

    def reachable(self, roots: list | None = None) -> set[int]:
        """Numbers of all objects that the trailer leads to."""
        keys = ("Root", "Info", "Encrypt")
        waiting = [r.number for v in (roots if roots is not None else [self.trailer.get(k) for k in keys]) for r in references(v)]
        seen: set[int] = set()
        while waiting:
            number = waiting.pop()
            if number not in seen and (value := self.get(number)) is not None:
                seen.add(number)
                waiting += [r.number for r in references(value)]
        return seen

    def save(self, encryption=None) -> bytes:
        """A full rewrite: what is reachable, numbered from 1 by old number, one table. encryption: from crypto.protect()."""
        trailer = {k: self.trailer[k] for k in ("Root", "Info", "ID") if k in self.trailer}
        kept = sorted(self.reachable([v for k, v in trailer.items() if k != "ID"]))
        names = {old: new for new, old in enumerate(kept, 1)}
        out, places = bytearray(_HEADER), []
        for old in kept:
            value = remapped(self.get(old), names)
            if encryption:
                value = encryption.encrypt(Ref(names[old], 0), value)
            places.append(len(out))
            out += format_indirect(Ref(names[old], 0), value)
        trailer = remapped(trailer, names)
        if encryption:
            places.append(len(out))
            out += format_indirect(Ref(len(places), 0), encryption.entries)
            trailer |= {"Encrypt": Ref(len(places), 0), "ID": [encryption.file_id, encryption.file_id]}
        return bytes(out) + _table(len(out), {n: p for n, p in enumerate(places, 1)}, [], trailer | {"Size": len(places) + 1})

    def save_incremental(self) -> bytes:
        """The bytes as they were, then the edits and a table that points back. Without bytes, a full rewrite."""
        if not self.data:
            return self.save()
        if self.policy_changed:
            raise Fault("unsupportedFeature", "an incremental save can't change the encryption")
        out = bytearray(self.data if self.data.endswith(b"\n") else self.data + b"\n")
        places = {}
        for number, value in sorted(self.edits.items()):
            if self.security:
                value = self.security.encrypt(Ref(number, 0), value)
            places[number] = len(out)
            out += format_indirect(Ref(number, 0), value)
        trailer = {k: v for k, v in self.trailer.items() if k in ("Root", "Info", "ID", "Encrypt")}
        previous = {"Prev": last_startxref(self.data)} if not self.repaired else {}
        size = max([0, *self.entries, *self.edits]) + 1
        return bytes(out) + _table(len(out), places, sorted(self.deleted), trailer | previous | {"Size": size})

    def save_sanitized(self, forbidden: list[bytes], encryption=None) -> bytes:
        """A full rewrite that fails if any of the forbidden byte strings is left, in the file or in a decoded stream.

        A stream whose encoded bytes alone hold one, as by chance, is encoded in another way.
        """
        needles = [n for n in forbidden if n]
        if not needles:
            return self.save(encryption)
        holds = lambda data: any(n in data for n in needles)
        plain, source = self.save(), self
        check = Document(plain)
        for number in check.numbers():
            if isinstance(value := check.get(number), Stream):
                try:
                    body = check.decoded(value)
                except Fault:
                    continue
                if holds(body):
                    raise Fault("residue", "forbidden bytes are left")
                if holds(value.raw):
                    source = check
                    entries = {k: v for k, v in value.entries.items() if k not in ("Filter", "F", "DecodeParms", "DP")}
                    for filters, raw in codecs.flate_variants(body):
                        check.set(Ref(number, 0), Stream(entries | {"Filter": filters}, raw))
                        if not holds(raw):
                            break
        if source is check:
            plain = check.save()
        if holds(plain):
            raise Fault("residue", "forbidden bytes are left")
        return source.save(encryption) if encryption else plain


def runs(numbers: list[int]) -> list[tuple[int, int]]:
    """(first, count) of runs of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for n in sorted(numbers):
        if out and out[-1][0] + out[-1][1] == n:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((n, 1))
    return out


def _table(at: int, places: dict[int, int], freed: list[int], trailer: dict) -> bytes:
    rows = {0: b"0000000000 65535 f \n"} | {n: b"%010d 00000 n \n" % p for n, p in places.items()} | {n: b"0000000000 00001 f \n" for n in freed}
    out = b"xref\n"
    for first, count in runs(list(rows)):
        out += b"%d %d\n" % (first, count) + b"".join(rows[n] for n in range(first, first + count))
    return out + b"trailer\n" + format_value(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at
