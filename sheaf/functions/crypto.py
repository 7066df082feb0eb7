"""Document encryption: RC4 and AES, key derivation of revisions 2 to 6, object keys.

RC4 and AES in CBC mode go through the OpenSSL library that Python's ssl module is built on, where ctypes can load it; else
through the plain versions here, which give the same bytes.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import os
from dataclasses import dataclass, field
from functools import cache, cached_property, lru_cache

from sheaf.sources.syntax import Fault, Name, Ref, Stream

# Fixed value: the padding of passwords.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


@cache
def _block(size: int):
    return ctypes.c_char * size


def _room(size: int):
    """At least so many bytes: of few sizes, as each is a type that takes long to make."""
    return _block(1 << max(size, 1).bit_length())()


# Fixed value: at least the library's state, 258 integers.
_RC4_STATE = 2080


def rc4(key: bytes, data: bytes) -> bytes:
    library = _native()
    if library is None or not key or not hasattr(library, "RC4_set_key"):
        return plain_rc4(key, data)
    state, out = _room(_RC4_STATE), _room(len(data))
    library.RC4_set_key(state, len(key), key)
    library.RC4(state, ctypes.c_size_t(len(data)), data, out)
    return ctypes.string_at(out, len(data))


def plain_rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    i, j, out = 0, 0, bytearray(len(data))
    for n, byte in enumerate(data):
        i = (i + 1) & 255
        a = state[i]
        j = (j + a) & 255
        b = state[j]
        state[i], state[j] = b, a
        out[n] = byte ^ state[(a + b) & 255]
    return bytes(out)


# -- AES, its tables made from the field's arithmetic -------------------------------------------------


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _tables() -> tuple[bytes, bytes]:
    box, p, q = bytearray(256), 1, 1
    while True:
        p ^= _double(p) & 255
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 255
        if q & 0x80:
            q ^= 9
        turn = lambda n, q=q: ((q << n) | (q >> (8 - n))) & 255
        box[p] = q ^ turn(1) ^ turn(2) ^ turn(3) ^ turn(4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = bytearray(256)
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


_BOX, _BACK = _tables()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a) & 255, b >> 1
    return out


_BY = {n: bytes(_times(i, n) for i in range(256)) for n in (2, 3, 9, 11, 13, 14)}
_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_UNSHIFT = [(i - 4 * (i % 4)) % 16 for i in range(16)]


@cache
def _native():
    """OpenSSL's library, or None."""
    try:
        library = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")
        for name in ("EVP_CIPHER_CTX_new", "EVP_aes_128_cbc", "EVP_aes_256_cbc"):
            getattr(library, name).restype = ctypes.c_void_p
        return library
    except (OSError, AttributeError):
        return None


def _evp(key: bytes, iv: bytes, data: bytes, seal: int) -> bytes:
    """CBC of whole blocks, without padding."""
    library = _native()
    context = ctypes.c_void_p(library.EVP_CIPHER_CTX_new())
    kind = ctypes.c_void_p((library.EVP_aes_256_cbc if len(key) == 32 else library.EVP_aes_128_cbc)())
    out, size = _room(len(data) + 32), ctypes.c_int(0)
    try:
        if len(data) % 16 or not library.EVP_CipherInit_ex(context, kind, None, key, iv, seal):
            raise Fault("crypto", "not whole blocks")
        library.EVP_CIPHER_CTX_set_padding(context, 0)
        if not library.EVP_CipherUpdate(context, out, ctypes.byref(size), data, len(data)):
            raise Fault("crypto", "the cipher failed")
        return ctypes.string_at(out, size.value)
    finally:
        library.EVP_CIPHER_CTX_free(context)


class AES:
    def __init__(self, key: bytes):
        self.key = key

    @cached_property
    def rounds(self) -> list[bytes]:
        key = self.key
        n = len(key) // 4
        words, step = [key[4 * i : 4 * i + 4] for i in range(n)], 1
        for i in range(n, 4 * (n + 7)):
            w = words[-1]
            if i % n == 0:
                w = bytes(_BOX[b] for b in w[1:] + w[:1])
                w = bytes([w[0] ^ step]) + w[1:]
                step = _double(step) & 255
            elif n > 6 and i % n == 4:
                w = bytes(_BOX[b] for b in w)
            words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
        return [b"".join(words[4 * i : 4 * i + 4]) for i in range(n + 7)]

    def block(self, data: bytes) -> bytes:
        two, three = _BY[2], _BY[3]
        s = bytes(a ^ b for a, b in zip(data, self.rounds[0], strict=True))
        for key in self.rounds[1:-1]:
            t = [_BOX[s[i]] for i in _SHIFT]
            s = bytes(x ^ k for x, k in zip((v for c in range(0, 16, 4) for a, b, d, e in [t[c : c + 4]] for v in (two[a] ^ three[b] ^ d ^ e, a ^ two[b] ^ three[d] ^ e, a ^ b ^ two[d] ^ three[e], three[a] ^ b ^ d ^ two[e])), key, strict=True))
        return bytes(_BOX[s[i]] ^ k for i, k in zip(_SHIFT, self.rounds[-1], strict=True))

    def unblock(self, data: bytes) -> bytes:
        n9, n11, n13, n14 = _BY[9], _BY[11], _BY[13], _BY[14]
        s = bytes(a ^ b for a, b in zip(data, self.rounds[-1], strict=True))
        for key in reversed(self.rounds[1:-1]):
            t = [_BACK[s[i]] ^ k for i, k in zip(_UNSHIFT, key, strict=True)]
            s = bytes(v for c in range(0, 16, 4) for a, b, d, e in [t[c : c + 4]] for v in (n14[a] ^ n11[b] ^ n13[d] ^ n9[e], n9[a] ^ n14[b] ^ n11[d] ^ n13[e], n13[a] ^ n9[b] ^ n14[d] ^ n11[e], n11[a] ^ n13[b] ^ n9[d] ^ n14[e]))
        return bytes(_BACK[s[i]] ^ k for i, k in zip(_UNSHIFT, self.rounds[0], strict=True))

    def cbc(self, data: bytes, iv: bytes) -> bytes:
        if _native() is not None:
            return _evp(self.key, iv, data, 1)
        out, last = [], iv
        for i in range(0, len(data), 16):
            last = self.block(bytes(a ^ b for a, b in zip(data[i : i + 16], last, strict=True)))
            out.append(last)
        return b"".join(out)

    def uncbc(self, data: bytes, iv: bytes) -> bytes:
        if _native() is not None:
            return _evp(self.key, iv, data, 0)
        out, last = [], iv
        for i in range(0, len(data), 16):
            out.append(bytes(a ^ b for a, b in zip(self.unblock(data[i : i + 16]), last, strict=True)))
            last = data[i : i + 16]
        return b"".join(out)


def aes_seal(key: bytes, data: bytes, iv: bytes) -> bytes:
    """CBC with PKCS#7, the vector first."""
    fill = 16 - len(data) % 16
    return iv + AES(key).cbc(data + bytes([fill]) * fill, iv)


def aes_open(key: bytes, data: bytes) -> bytes:
    if len(data) < 32 or len(data) % 16:
        raise Fault("crypto", "not whole blocks")
    plain = AES(key).uncbc(data[16:], data[:16])
    fill = plain[-1]
    if not 1 <= fill <= 16 or plain[-fill:] != bytes([fill]) * fill:
        raise Fault("crypto", "broken padding")
    return plain[:-fill]


# -- keys ---------------------------------------------------------------------------------------------


def pad(password: bytes) -> bytes:
    return (password + PADDING)[:32]


def file_key(password: bytes, owner: bytes, permissions: int, file_id: bytes, revision: int, length: int, metadata: bool = True) -> bytes:
    data = pad(password) + owner[:32] + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id
    key = hashlib.md5(data + (b"" if metadata or revision < 4 else b"\xff" * 4)).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:length]).digest()
    return key[:length]


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PADDING)
    out = hashlib.md5(PADDING + file_id).digest()
    for i in range(20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out + bytes(16)


@lru_cache(4096)
def owner_key(password: bytes, revision: int, length: int) -> bytes:
    key = hashlib.md5(pad(password)).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    return key[:length]


@lru_cache(4096)  # the same for all documents of the same passwords
def owner_entry(owner: bytes, user: bytes, revision: int, length: int) -> bytes:
    key, out = owner_key(owner or user, revision, length), pad(user)
    for i in range(20 if revision >= 3 else 1):
        out = rc4(bytes(b ^ i for b in key), out)
    return out


@lru_cache(4096)
def user_of_owner(owner: bytes, entry: bytes, revision: int, length: int) -> bytes:
    """The padded user's password that an owner's password gets out of /O."""
    key, out = owner_key(owner, revision, length), entry[:32]
    for i in range(19 if revision >= 3 else 0, -1, -1):
        out = rc4(bytes(b ^ i for b in key), out)
    return out


def hash_r6(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """At least 64 rounds, until the last byte is small enough for the round."""
    key, i, last = hashlib.sha256(password + salt + user).digest(), 0, 0
    while i < 64 or last > i - 32:
        block = AES(key[:16]).cbc((password + key + user) * 64, key[16:32])
        key = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(block[:16]) % 3](block).digest()
        last, i = block[-1], i + 1
    return key[:32]


def object_key(key: bytes, ref: Ref, aes: bool) -> bytes:
    data = key + (ref.number & 0xFFFFFF).to_bytes(3, "little") + (ref.generation & 0xFFFF).to_bytes(2, "little") + (b"sAlT" if aes else b"")
    return hashlib.md5(data).digest()[: min(len(key) + 5, 16)]


@dataclass
class Security:
    """A file key and how strings and streams are enciphered: rc4, aes (128), aes256 or none."""

    key: bytes
    method: str
    entries: dict
    file_id: bytes
    skip: int | None = None
    draw: object = field(default=os.urandom, repr=False)

    def _cipher(self, ref: Ref, data: bytes, seal: bool) -> bytes:
        if self.method == "none":
            return data
        key = self.key if self.method == "aes256" else object_key(self.key, ref, self.method == "aes")
        if self.method == "rc4":
            return rc4(key, data)
        return aes_seal(key, data, self.draw(16)) if seal else aes_open(key, data) if data else b""

    def _walk(self, ref: Ref, value, seal: bool):
        if isinstance(value, bytes):
            return self._cipher(ref, value, seal)
        if isinstance(value, list):
            return [self._walk(ref, v, seal) for v in value]
        if isinstance(value, dict):
            return {k: self._walk(ref, v, seal) for k, v in value.items()}
        if isinstance(value, Stream):
            if value.entries.get("Type") == "XRef":
                return value
            return Stream(self._walk(ref, value.entries, seal), self._cipher(ref, value.raw, seal))
        return value

    def decrypt(self, ref: Ref, value):
        return value if ref.number == self.skip else self._walk(ref, value, False)

    def encrypt(self, ref: Ref, value):
        return value if ref.number == self.skip else self._walk(ref, value, True)


def unlock(document, password: str | bytes) -> Security:
    """Tries the password as the user's, then as the owner's; fails closed with `needsPassword`."""
    value = document.trailer["Encrypt"]
    skip = value.number if isinstance(value, Ref) else None
    entries = {k: document.resolve(v) for k, v in document.dictionary(value).items()}
    ids = document.array(document.trailer.get("ID"))
    file_id = ids[0] if ids and isinstance(ids[0], bytes) else b""

    def number(key: str, default: int) -> int:
        found = entries.get(key, default)
        if not isinstance(found, (int, float)) or isinstance(found, bool) or not -(1 << 32) <= found < 1 << 32:
            raise Fault("crypto", f"/{key} is not a number that fits")
        return int(found)

    def string(key: str) -> bytes:
        found = entries.get(key, b"")
        if not isinstance(found, bytes):
            raise Fault("crypto", f"/{key} is not a string")
        return found

    version, revision = number("V", 0), number("R", 0)
    if entries.get("Filter") != "Standard" or version not in (1, 2, 4, 5):
        raise Fault("unsupportedFeature", "this security handler")
    owner, user, permissions = string("O"), string("U"), number("P", 0)
    length = 5 if version == 1 else min(16, max(5, number("Length", 40) // 8)) if version == 2 else 16
    method = "rc4"
    if version >= 4:
        filters, name = document.dictionary(entries.get("CF")), entries.get("StmF", "Identity")
        kind = document.resolve(document.dictionary(filters.get(name) if isinstance(name, str) else None).get("CFM")) if name != "Identity" else "None"
        method = {"V2": "rc4", "AESV2": "aes", "AESV3": "aes256", "None": "none"}.get(str(kind))
        if method is None:
            raise Fault("unsupportedFeature", "this crypt filter")
    document.cache.clear()
    if revision >= 5:
        secret = (password.encode() if isinstance(password, str) else password)[:127]
        for stored, sealed, more in ((user, string("UE"), b""), (owner, string("OE"), user[:48])):
            if len(stored) >= 48 and hash_r6(secret, stored[32:40], more) == stored[:32]:
                return Security(AES(hash_r6(secret, stored[40:48], more)).uncbc(sealed[:32], bytes(16)), method, entries, file_id, skip)
        raise Fault("needsPassword", "neither the user's nor the owner's password")
    secret = password.encode("latin-1", "replace") if isinstance(password, str) else password
    metadata = entries.get("EncryptMetadata", True) is not False

    def matches(guess: bytes) -> bytes | None:
        key = file_key(guess, owner, permissions, file_id, revision, length, metadata)
        n = 32 if revision == 2 else 16
        return key if user_entry(key, file_id, revision)[:n] == user[:n] else None

    if (key := matches(secret)) is None:
        key = matches(user_of_owner(secret, owner, revision, length))
    if key is None:
        raise Fault("needsPassword", "neither the user's nor the owner's password")
    return Security(key, method, entries, file_id, skip)


def protect(method: str, user: str, owner: str, permissions: int = -4, file_id: bytes | None = None, draw=os.urandom) -> Security:
    """What encrypts a document on saving: rc4_40, rc4_128, aes128 or aes256."""
    file_id = file_id or draw(16)
    if method == "aes256":
        secret_u, secret_o, key = user.encode()[:127], owner.encode()[:127], draw(32)
        su, so = draw(16), draw(16)
        u = hash_r6(secret_u, su[:8]) + su
        ue = AES(hash_r6(secret_u, su[8:])).cbc(key, bytes(16))
        o = hash_r6(secret_o, so[:8], u) + so
        oe = AES(hash_r6(secret_o, so[8:], u)).cbc(key, bytes(16))
        perms = AES(key).block((permissions & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + b"Tadb" + draw(4))
        crypt = {"StdCF": {"CFM": Name("AESV3"), "AuthEvent": Name("DocOpen"), "Length": 32}}
        entries = {"Filter": Name("Standard"), "V": 5, "R": 6, "Length": 256, "P": permissions, "U": u, "UE": ue, "O": o, "OE": oe, "Perms": perms, "CF": crypt, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
        return Security(key, "aes256", entries, file_id, draw=draw)
    version, revision, length, cipher = {"rc4_40": (1, 2, 5, "rc4"), "rc4_128": (2, 3, 16, "rc4"), "aes128": (4, 4, 16, "aes")}[method]
    secret_u, secret_o = user.encode("latin-1", "replace"), owner.encode("latin-1", "replace")
    o = owner_entry(secret_o, secret_u, revision, length)
    key = file_key(secret_u, o, permissions, file_id, revision, length)
    entries = {"Filter": Name("Standard"), "V": version, "R": revision, "Length": 8 * length, "P": permissions, "O": o, "U": user_entry(key, file_id, revision)}
    if version == 4:
        entries |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "AuthEvent": Name("DocOpen"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    return Security(key, cipher, entries, file_id, draw=draw)


# -- permissions --------------------------------------------------------------------------------------

# Bit n of /P is 1 << (n - 1).
PERMISSION_BITS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "accessibility": 10, "assemble": 11, "print_high": 12}


def permission_value(granted) -> int:
    """/P as a signed 32-bit number: reserved bits 1 but the lowest two."""
    bits = sum(1 << (n - 1) for n in PERMISSION_BITS.values())
    value = (0xFFFFFFFC & ~bits) | sum(1 << (PERMISSION_BITS[g] - 1) for g in granted)
    return value - (1 << 32) if value & 1 << 31 else value
