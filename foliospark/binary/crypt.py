"""The standard security handler: RC4 and AES in plain Python, keys from passwords, strings and streams decrypted."""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np

from .syntax import HexText, PdfError, Ref, Stream, Text

#: The padding of passwords (32 bytes fixed by the format).
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _rc4_state(key: bytes) -> list[int]:
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        a = s[i]
        j = j + a + k & 255
        s[i] = s[j]
        s[j] = a
    return s


@functools.lru_cache(maxsize=512)
def _shared_state(key: bytes) -> tuple[int, ...]:
    return tuple(_rc4_state(key))


def rc4(key: bytes, data: bytes, shared: bool = False) -> bytes:
    """``shared`` keeps the state of a key that many files have."""
    s = list(_shared_state(key)) if shared else _rc4_state(key)
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _times2(a: int) -> int:
    return (a << 1 ^ (0x11B if a & 0x80 else 0)) & 0x1FF if a & 0x80 else a << 1


@functools.cache
def _tables() -> tuple[list[int], list[int], list[list[int]]]:
    """The S-box, its inverse and products by 2, 3, 9, 11, 13, 14, from GF(256) itself."""
    exp, log, x = [0] * 512, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= _times2(x)  # times 3
        x &= 0xFF
    for i in range(255, 512):
        exp[i] = exp[i - 255]
    box = [0] * 256
    for a in range(256):
        b = exp[255 - log[a]] if a else 0
        r = 0x63
        for k in range(5):
            r ^= (b << k | b >> (8 - k)) & 0xFF
        box[a] = r
    inverse = [0] * 256
    for a, b in enumerate(box):
        inverse[b] = a
    mul = {m: [exp[log[a] + log[m]] if a else 0 for a in range(256)] for m in (2, 3, 9, 11, 13, 14)}
    return box, inverse, mul


@functools.lru_cache(maxsize=64)
def _schedule(key: bytes) -> list[list[int]]:
    box, _, mul = _tables()
    n = len(key) // 4
    w = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    rcon = 1
    for i in range(n, 4 * (n + 7)):
        t = w[i - 1][:]
        if i % n == 0:
            t = [box[x] for x in t[1:] + t[:1]]
            t[0] ^= rcon
            rcon = mul[2][rcon]
        elif n > 6 and i % n == 4:
            t = [box[x] for x in t]
        w.append([a ^ b for a, b in zip(w[i - n], t, strict=True)])
    return [sum(w[k : k + 4], []) for k in range(0, len(w), 4)]


@functools.cache
def _fast() -> list[list[int]]:
    """Four tables that join the S-box with the mixing of columns, as 32-bit words."""
    box, _, mul = _tables()
    first = [mul[2][s] << 24 | s << 16 | s << 8 | mul[3][s] for s in box]
    return [[(v >> 8 * k | v << (32 - 8 * k)) & 0xFFFFFFFF for v in first] for k in range(4)]


@functools.lru_cache(maxsize=64)
def _words(key: bytes) -> list[int]:
    return [int.from_bytes(bytes(r[k : k + 4]), "big") for r in _schedule(key) for k in range(0, 16, 4)]


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Without padding; data is whole blocks."""
    w, (t0, t1, t2, t3), box = _words(key), _fast(), _tables()[0]
    last = len(w) - 4
    out = []
    a, b, c, d = struct.unpack(">4I", iv)
    for p, q, r, s in struct.iter_unpack(">4I", data):
        a, b, c, d = a ^ p ^ w[0], b ^ q ^ w[1], c ^ r ^ w[2], d ^ s ^ w[3]
        for k in range(4, last, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ w[k],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ w[k + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ w[k + 2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ w[k + 3],
            )
        a, b, c, d = (
            (box[a >> 24] << 24 | box[b >> 16 & 255] << 16 | box[c >> 8 & 255] << 8 | box[d & 255]) ^ w[last],
            (box[b >> 24] << 24 | box[c >> 16 & 255] << 16 | box[d >> 8 & 255] << 8 | box[a & 255]) ^ w[last + 1],
            (box[c >> 24] << 24 | box[d >> 16 & 255] << 16 | box[a >> 8 & 255] << 8 | box[b & 255]) ^ w[last + 2],
            (box[d >> 24] << 24 | box[a >> 16 & 255] << 16 | box[b >> 8 & 255] << 8 | box[c & 255]) ^ w[last + 3],
        )
        out += (a, b, c, d)
    return struct.pack(f">{len(out)}I", *out)


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """All blocks at once: in decryption none waits for another."""
    whole = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    _, inverse, mul = _tables()
    inv = np.array(inverse, np.uint8)
    m = {k: np.array(mul[k], np.uint8) for k in (9, 11, 13, 14)}
    keys = [np.array(k, np.uint8) for k in _schedule(key)]
    back = [(i - 4 * (i % 4)) % 16 for i in range(16)]
    s = whole ^ keys[-1]
    for n in range(len(keys) - 2, -1, -1):
        s = inv[s[:, back]] ^ keys[n]
        if n:
            a, b, c, d = (s[:, k::4] for k in range(4))
            t = np.empty_like(s)
            t[:, 0::4] = m[14][a] ^ m[11][b] ^ m[13][c] ^ m[9][d]
            t[:, 1::4] = m[9][a] ^ m[14][b] ^ m[11][c] ^ m[13][d]
            t[:, 2::4] = m[13][a] ^ m[9][b] ^ m[14][c] ^ m[11][d]
            t[:, 3::4] = m[11][a] ^ m[13][b] ^ m[9][c] ^ m[14][d]
            s = t
    before = np.vstack([np.frombuffer(iv, np.uint8)[None, :], whole[:-1]]) if len(whole) else whole
    return (s ^ before).tobytes()


def pad(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def _aes_open(key: bytes, data: bytes) -> bytes:
    """Data behind its initial vector, padding removed."""
    if len(data) < 32 or len(data) % 16:
        if len(data) <= 16:
            return b""
        raise PdfError("decrypt_failed", "not whole blocks")
    out = aes_cbc_decrypt(key, data[:16], data[16:])
    n = out[-1]
    if not 1 <= n <= 16 or out[-n:] != bytes([n]) * n:
        raise PdfError("decrypt_failed", "padding")
    return out[:-n]


def aes_seal(key: bytes, iv: bytes, data: bytes) -> bytes:
    return iv + aes_cbc_encrypt(key, iv, pad(data))


def object_key(key: bytes, ref: Ref, aes: bool) -> bytes:
    salted = key + struct.pack("<I", ref.n)[:3] + struct.pack("<I", ref.g)[:2] + (b"sAlT" if aes else b"")
    return hashlib.md5(salted).digest()[: min(16, len(key) + 5)]


def _chained(key: bytes, data: bytes, rounds, shared: bool = False) -> bytes:
    """Rounds of RC4, the key's bytes changed by the round's number."""
    for i in rounds:
        data = rc4(bytes(b ^ i for b in key), data, shared)
    return data


@functools.lru_cache(maxsize=256)
def owner_entry(key: bytes, user: str, rounds: int) -> bytes:
    """The user's password under the owner's key: the same in all files of two passwords."""
    return _chained(key, (user.encode("latin-1", "replace") + PAD)[:32], range(rounds))


@functools.lru_cache(maxsize=256)
def _owner_key(password: str, rounds: int, size: int) -> bytes:
    h = hashlib.md5((password.encode("latin-1", "replace") + PAD)[:32]).digest()
    for _ in range(rounds):
        h = hashlib.md5(h).digest()
    return h[:size]


def hash_r6(password: bytes, salt: bytes, udata: bytes = b"") -> bytes:
    """The hash of revision 6: rounds of AES and a SHA that the output picks, 64 at least."""
    k, i = hashlib.sha256(password + salt + udata).digest(), 0
    while True:
        e = aes_cbc_encrypt(k[:16], k[16:32], (password + k + udata) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Handler:
    """Keys of one encrypted file. ``key`` is None until ``unlock``."""

    def __init__(self, d: dict, file_id: bytes):
        if str(d.get("Filter")) != "Standard":
            raise PdfError("unsupported_encryption", str(d.get("Filter")))
        self.v, self.r = d.get("V", 0), d.get("R", 0)
        if self.v not in (1, 2, 4, 5) or self.v == 5 and self.r != 6:
            raise PdfError("unsupported_encryption", f"V {self.v} R {self.r}")
        self.o, self.u = bytes(d.get("O", b"")), bytes(d.get("U", b""))
        self.oe, self.ue = bytes(d.get("OE", b"")), bytes(d.get("UE", b""))
        self.p, self.id = d.get("P", 0) & 0xFFFFFFFF, file_id
        self.meta = d.get("EncryptMetadata", True) is not False
        self.size = 5 if self.v == 1 else 16 if self.v == 4 else 32 if self.v == 5 else max(5, d.get("Length", 40) // 8)
        self.key: bytes | None = None
        method = {"V2": "rc4", "AESV2": "aes", "AESV3": "aes", "None": "none"}
        crypts = d.get("CF", {}) if self.v >= 4 else {}
        self.methods = {str(n): method.get(str(c.get("CFM", "None")), "none") for n, c in crypts.items() if isinstance(c, dict)} | {"Identity": "none"}
        both = "rc4" if self.v < 4 else "none"
        self.for_strings = self.methods.get(str(d.get("StrF", "Identity")), both) if self.v >= 4 else both
        self.for_streams = self.methods.get(str(d.get("StmF", "Identity")), both) if self.v >= 4 else both

    def unlock(self, password: str = "") -> str:
        """Tries the empty password, then the given one, as user and as owner; says which fits.

        To RC4's and AES-128's files a given password is tried as the owner's first: it tells the user's password, so a file
        that it opens takes one attempt in place of four. What it says is as above."""
        if password and self.v < 5 and self._owner(password):
            return "user" if self.of_user in [(p.encode("latin-1", "replace") + PAD)[:32] for p in ("", password)] else "owner"
        for given in dict.fromkeys(["", password]):
            for who, attempt in (("user", self._user), ("owner", self._owner)):
                if who == "owner" and given and self.v < 5:
                    continue  # tried above
                if attempt(given):
                    return who
        raise PdfError("wrong_password" if password else "password_required")

    def _from_user(self, padded: bytes) -> bytes:
        h = hashlib.md5(padded + self.o[:32] + struct.pack("<I", self.p) + self.id + (b"\xff\xff\xff\xff" if self.r >= 4 and not self.meta else b"")).digest()
        for _ in range(50 if self.r >= 3 else 0):
            h = hashlib.md5(h[: self.size]).digest()
        return h[: self.size]

    def _fits(self, key: bytes) -> bool:
        if self.r == 2:
            return rc4(key, PAD) == self.u[:32]
        return _chained(key, hashlib.md5(PAD + self.id).digest(), range(20))[:16] == self.u[:16]

    def _user(self, password: str) -> bool:
        if self.v == 5:
            p = password.encode()[:127]
            if hash_r6(p, self.u[32:40]) != self.u[:32]:
                return False
            self.key = aes_cbc_decrypt(hash_r6(p, self.u[40:48]), bytes(16), self.ue)
            return True
        key = self._from_user((password.encode("latin-1", "replace") + PAD)[:32])
        if self._fits(key):
            self.key = key
        return self.key is not None

    def owner_key(self, password: str) -> bytes:
        return _owner_key(password, 50 if self.r >= 3 else 0, self.size)

    def _owner(self, password: str) -> bool:
        if self.v == 5:
            p = password.encode()[:127]
            if hash_r6(p, self.o[32:40], self.u[:48]) != self.o[:32]:
                return False
            self.key = aes_cbc_decrypt(hash_r6(p, self.o[40:48], self.u[:48]), bytes(16), self.oe)
            return True
        self.of_user = _chained(self.owner_key(password), self.o[:32], range(19 if self.r >= 3 else 0, -1, -1), shared=True)
        key = self._from_user(self.of_user)
        if self._fits(key):
            self.key = key
        return self.key is not None

    def _open(self, method: str, ref: Ref, data: bytes) -> bytes:
        if method == "none" or not data:
            return data
        key = self.key if self.v == 5 else object_key(self.key, ref, method == "aes")
        return rc4(key, data) if method == "rc4" else _aes_open(key, data)

    def value(self, v, ref: Ref):
        """v with its strings and its stream in the clear."""
        if isinstance(v, HexText):
            return HexText(self._open(self.for_strings, ref, v))
        if isinstance(v, Text):
            return Text(self._open(self.for_strings, ref, v))
        if isinstance(v, list):
            return [self.value(x, ref) for x in v]
        if isinstance(v, dict):
            return {k: self.value(x, ref) for k, x in v.items()}
        if isinstance(v, Stream):
            kind = str(v.dict.get("Type", ""))
            if kind == "XRef" or kind == "Metadata" and not self.meta:
                return v
            return Stream(self.value(v.dict, ref), self._open(self._method_of(v.dict), ref, v.raw))
        return v

    def _method_of(self, d: dict) -> str:
        """Only a Crypt filter of its own changes a stream's method."""
        from .filters import chain_of

        for name, parms in chain_of(d):
            if name == "Crypt":
                return self.methods.get(str(parms.get("Name", "Identity")), "none")
        return self.for_streams
