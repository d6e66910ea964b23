"""QR codes, byte mode, versions 1 to 20: codewords, Reed-Solomon blocks, modules, masks."""

from __future__ import annotations

import functools

import numpy as np

#: Error-correction codewords of a block and number of blocks, versions 1 to 20 (fixed values).
EC = {
    "L": ((7, 10, 15, 20, 26, 18, 20, 24, 30, 18, 20, 24, 26, 30, 22, 24, 28, 30, 28, 28), (1, 1, 1, 1, 1, 2, 2, 2, 2, 4, 4, 4, 4, 4, 6, 6, 6, 6, 7, 8)),
    "M": ((10, 16, 26, 18, 24, 16, 18, 22, 22, 26, 30, 22, 22, 24, 24, 28, 28, 26, 26, 26), (1, 1, 1, 2, 2, 4, 4, 4, 5, 5, 5, 8, 9, 9, 10, 10, 11, 13, 14, 16)),
    "Q": ((13, 22, 18, 26, 18, 24, 18, 22, 20, 24, 28, 26, 24, 20, 30, 24, 28, 28, 26, 30), (1, 1, 2, 2, 4, 4, 6, 6, 8, 8, 8, 10, 12, 16, 12, 17, 16, 18, 21, 20)),
    "H": ((17, 28, 22, 16, 22, 28, 26, 26, 24, 28, 24, 28, 22, 24, 24, 30, 28, 28, 26, 28), (1, 1, 2, 4, 4, 4, 5, 6, 8, 8, 11, 11, 16, 16, 18, 16, 19, 21, 25, 25)),
}
LEVEL_BITS = {"L": 1, "M": 0, "Q": 3, "H": 2}
MAX_VERSION = 20


def raw_codewords(version: int) -> int:
    n = (16 * version + 128) * version + 64
    if version >= 2:
        marks = version // 7 + 2
        n -= (25 * marks - 10) * marks - 55
        if version >= 7:
            n -= 36
    return n // 8


def data_codewords(version: int, level: str) -> int:
    ec, blocks = EC[level]
    return raw_codewords(version) - ec[version - 1] * blocks[version - 1]


def capacity(version: int, level: str) -> int:
    """Bytes of text that fit."""
    return data_codewords(version, level) - (2 if version < 10 else 3)


@functools.lru_cache(maxsize=8192)
def min_version(size: int, level: str) -> int:
    for v in range(1, MAX_VERSION + 1):
        if capacity(v, level) >= size:
            return v
    raise ValueError("data_too_long")


@functools.cache
def _field() -> tuple[list[int], list[int]]:
    exp, log, x = [0] * 512, [0] * 256, 1
    for k in range(255):
        exp[k] = exp[k + 255] = x
        log[x] = k
        x <<= 1
        if x & 0x100:
            x ^= 0x11D
    return exp, log


@functools.cache
def generator(n: int) -> tuple[int, ...]:
    """Coefficients of the product of (x - 2**k), k < n, without the leading 1."""
    exp, log = _field()
    g = [1]
    for k in range(n):
        low = [0] + [exp[log[c] + k] if c else 0 for c in g]
        g = [a ^ b for a, b in zip([*g, 0], low, strict=True)]
    return tuple(g[1:])


@functools.cache
def _products(n: int) -> np.ndarray:
    """The generator's coefficients times each byte."""
    exp, log = _field()
    return np.array([[exp[log[c] + log[f]] if c and f else 0 for c in generator(n)] for f in range(256)], np.uint8)


def remainder(data: list[int], n: int) -> list[int]:
    """Reed-Solomon codewords of data."""
    return remainders(np.array([data], np.uint8), n)[0].tolist()


def remainders(data: np.ndarray, n: int) -> np.ndarray:
    """Reed-Solomon codewords of each row of data."""
    products, out = _products(n), np.zeros((len(data), n + 1), np.uint8)
    for d in data.T:
        f = d ^ out[:, 0]
        out[:, :-1] = out[:, 1:]
        out[:, :-1] ^= products[f]
    return out[:, :-1]


def codewords(texts: list[bytes], version: int, level: str) -> np.ndarray:
    """Data and error correction, interleaved; a row for each text."""
    total, count = data_codewords(version, level), 8 if version < 10 else 16
    words = np.empty((len(texts), total), np.uint8)
    for row, data in zip(words, texts, strict=True):
        # four bits of mode, the length, the bytes and four zeros, as far as they fit, are whole bytes
        head = ((4 << count | len(data)) << 8 * len(data) | int.from_bytes(data, "big")) << 4
        size = (count + 8) // 8 + len(data)
        row[:size] = np.frombuffer(head.to_bytes(size, "big"), np.uint8)
        row[size:] = np.resize(np.array([0xEC, 0x11], np.uint8), total - size)
    ec, blocks = EC[level][0][version - 1], EC[level][1][version - 1]
    short, long = total // blocks, total % blocks
    own, k = [], 0
    for b in range(blocks):
        size = short + (b >= blocks - long)
        own.append(words[:, k : k + size])
        k += size
    checks = [remainders(b, ec) for b in own]
    return np.stack([b[:, i] for i in range(short + 1) for b in own if i < b.shape[1]] + [c[:, i] for i in range(ec) for c in checks], 1)


def alignment(version: int) -> list[int]:
    if version == 1:
        return []
    n = version // 7 + 2
    step = (version * 8 + n * 3 + 5) // (n * 4 - 4) * 2
    return [6, *sorted(version * 4 + 10 - k * step for k in range(n - 1))]


def _bch(value: int, bits: int, poly: int) -> int:
    r = value << bits
    while r.bit_length() > bits:
        r ^= poly << (r.bit_length() - bits - 1)
    return value << bits | r


def format_bits(level: str, mask: int) -> int:
    return _bch(LEVEL_BITS[level] << 3 | mask, 10, 0x537) ^ 0x5412


def _frame(version: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed modules, and which modules take no data."""
    n = 4 * version + 17
    m, used = np.zeros((n, n), np.uint8), np.zeros((n, n), bool)
    m[6, :] = m[:, 6] = np.arange(n) % 2 == 0
    used[6, :] = used[:, 6] = True
    places = alignment(version)
    ends = {(6, 6), (6, n - 7), (n - 7, 6)}
    for r in places:
        for c in places:
            if (r, c) not in ends:
                d = np.maximum(*np.abs(np.mgrid[-2:3, -2:3]))
                m[r - 2 : r + 3, c - 2 : c + 3] = d != 1
                used[r - 2 : r + 3, c - 2 : c + 3] = True
    d = np.maximum(*np.abs(np.mgrid[-4:5, -4:5]))
    finder = ((d != 2) & (d != 4)).astype(np.uint8)
    m[:8, :8], used[:9, :9] = finder[1:, 1:], True
    m[:8, n - 8 :], used[:9, n - 8 :] = finder[1:, :8], True
    m[n - 8 :, :8], used[n - 8 :, :9] = finder[:8, 1:], True
    m[n - 8, 8] = 1
    if version >= 7:
        used[:6, n - 11 : n - 8] = used[n - 11 : n - 8, :6] = True
    return m, used


def _path(n: int):
    """Places of data in order: pairs of columns from the right, up and down in turn, without the timing column."""
    up = True
    for right in [*range(n - 1, 6, -2), *range(5, 0, -2)]:
        for r in range(n - 1, -1, -1) if up else range(n):
            yield r, right
            yield r, right - 1
        up = not up


def masked(mask: int, n: int) -> np.ndarray:
    r, c = np.mgrid[:n, :n]
    rule = ((r + c) % 2, r % 2, c % 3, (r + c) % 3, (r // 2 + c // 3) % 2, r * c % 2 + r * c % 3, (r * c % 2 + r * c % 3) % 2, ((r + c) % 2 + r * c % 3) % 2)
    return rule[mask] == 0


#: 10111010000 and its reverse, first module lowest.
_FINDERS = (0b00001011101, 0b10111010000)
#: Modules of all masks that are tried at once.
_AT_ONCE = 4_000_000


def penalty(m: np.ndarray) -> np.ndarray:
    """Of each symbol (the last two axes)."""
    n, out = m.shape[-1], 0
    for a in (m, m.swapaxes(-1, -2)):
        # windows as numbers: of 2, 4, 5 and 11 modules
        a = np.ascontiguousarray(a)
        two = a[..., :-1] | a[..., 1:] << 1
        four = two[..., :-2] | two[..., 2:] << 2
        five = four[..., :-1] | a[..., 4:] << 4
        even = (five == 0) | (five == 31)
        # a run of k >= 5 holds k - 4 windows of one colour, and begins once: k - 2
        first = even.copy()
        first[..., 1:] &= ~even[..., :-1]
        eight = four[..., :-4] | four[..., 4:] << 4
        eleven = eight[..., :-3].astype(np.uint16) | two[..., 8:-1].astype(np.uint16) << 8 | a[..., 10:].astype(np.uint16) << 10
        out = out + even.sum((-1, -2)) + 2 * first.sum((-1, -2)) + 40 * ((eleven == _FINDERS[0]) | (eleven == _FINDERS[1])).sum((-1, -2))
    across, down = m[..., :, 1:] == m[..., :, :-1], m[..., 1:, :] == m[..., :-1, :]
    same = across[..., 1:, :] & across[..., :-1, :] & down[..., :, 1:]
    dark = m.sum((-1, -2), dtype=np.int64) * 100 // (n * n)
    five = dark // 5 * 5
    return out + 3 * same.sum((-1, -2)) + np.minimum(abs(five - 50), abs(five + 5 - 50)) // 5 * 10


@functools.cache
def _layout(version: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fixed modules, rows and columns of data in order, and the modules that each mask turns."""
    m, used = _frame(version)
    free = np.array([(r, c) for r, c in _path(len(m)) if not used[r, c]])
    return m, free[:, 0], free[:, 1], np.array([masked(k, len(m)) & ~used for k in range(8)], np.uint8)


def encode_all(texts: list[str | bytes | None], level: str = "M") -> list[np.ndarray | None]:
    """Modules of each text, 1 dark; None where the text is null or too long for version 20. Texts of one version are made together.

    The mask is chosen before the format bits are placed."""
    level, by_version = level.upper(), {}
    out: list[np.ndarray | None] = [None] * len(texts)
    for k, t in enumerate(texts):
        data = t.encode() if isinstance(t, str) else t
        if data is not None and len(data) <= capacity(MAX_VERSION, level):
            by_version.setdefault(min_version(len(data), level), []).append((k, data))
    for version, of in by_version.items():
        frame, rows, columns, masks = _layout(version)
        step = max(1, _AT_ONCE // masks.size)
        for at in range(0, len(of), step):
            part = of[at : at + step]
            m = np.repeat(frame[None], len(part), 0)
            bits = np.unpackbits(codewords([d for _, d in part], version, level), axis=1)
            m[:, rows[: bits.shape[1]], columns[: bits.shape[1]]] = bits[:, : len(rows)]
            tries = m[:, None] ^ masks
            best = penalty(tries).argmin(1)
            for i, (k, _) in enumerate(part):
                out[k] = _finish(tries[i, best[i]].copy(), version, level, int(best[i]))
    return out


def encode(text: str | bytes, level: str = "M") -> list[list[int]]:
    """Rows of modules, 1 dark. ValueError if the text is too long for version 20."""
    (m,) = encode_all([text], level)
    if m is None:
        raise ValueError("data_too_long")
    return m.tolist()


def _finish(m: np.ndarray, version: int, level: str, mask: int) -> np.ndarray:
    n, f = len(m), format_bits(level, mask)
    for k in range(15):
        b = f >> k & 1
        r = k if k < 6 else k + 1 if k < 8 else n - 15 + k
        c = n - 1 - k if k < 8 else 15 - k if k < 9 else 14 - k
        m[r, 8] = b
        m[8, c] = b
    m[n - 8, 8] = 1
    if version >= 7:
        v = _bch(version, 12, 0x1F25)
        for k in range(18):
            m[n - 11 + k % 3, k // 3] = m[k // 3, n - 11 + k % 3] = v >> k & 1
    return m
