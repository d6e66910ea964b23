import base64
import zlib

import numpy as np
import pytest
from foliospark.binary import filters
from foliospark.binary.syntax import Name, PdfError
from hypothesis import given
from hypothesis import strategies as st


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    """A plain encoder to check the decoder: clear, codes, end."""
    table, size = {bytes([i]): i for i in range(256)}, 258
    bits, n, width, out = 0, 0, 9, bytearray()

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)

    put(256)
    w = b""
    for c in data:
        wc = w + bytes([c])
        if wc in table:
            w = wc
            continue
        put(table[w])
        if size < 4095:
            table[wc] = size
            size += 1
            width = min(12, max(9, (size - 1 + early).bit_length()))
        else:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        w = bytes([c])
    if w:
        put(table[w])
        width = min(12, max(9, (size + early).bit_length()))
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


@given(st.binary(max_size=300))
def test_round_trips(data):
    assert filters.flate(zlib.compress(data), {}) == data
    assert filters.ascii85(base64.a85encode(data) + b"~>", {}) == data
    assert filters.ascii_hex(data.hex().encode() + b">", {}) == data


@pytest.mark.parametrize("data", [b"", b"a", b"-----A---B", bytes(range(256)) * 3, b"abcabcabc" * 400])
def test_lzw_tables(data):
    assert filters.lzw(lzw_encode(data), {}) == data


def test_lzw_of_the_specification():
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), {}) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_run_length():
    assert filters.run_length(bytes([2]) + b"abc" + bytes([254]) + b"z" + bytes([128]) + b"rest", {}) == b"abczzz"


@pytest.mark.parametrize("bpp", [1, 3, 4])
@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_predictors(kind, bpp):
    rng = np.random.default_rng(kind * 7 + bpp)
    px = rng.integers(0, 256, (5, 6 * bpp)).tolist()
    out = bytearray()
    for r, row in enumerate(px):
        out.append(kind)
        for i, v in enumerate(row):
            a = row[i - bpp] if i >= bpp else 0
            b = px[r - 1][i] if r else 0
            c = px[r - 1][i - bpp] if r and i >= bpp else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda q: (abs(p - q), (a, b, c).index(q)))
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    got = filters.unpredict(bytes(out), {"Predictor": 15, "Colors": bpp, "Columns": 6})
    assert got == bytes(v for row in px for v in row)


def test_tiff_predictor():
    assert filters.unpredict(bytes([1, 2, 3, 1, 1, 1]), {"Predictor": 2, "Colors": 3, "Columns": 2}) == bytes([1, 2, 3, 2, 3, 4])


def test_chain_and_faults():
    d = {"Filter": [Name("ASCIIHexDecode"), Name("FlateDecode")], "DecodeParms": [None]}
    assert filters.decode(zlib.compress(b"x").hex().encode() + b">", filters.chain_of(d)) == b"x"
    for name, data in (("JPXDecode", b""), ("FlateDecode", b"no"), ("ASCII85Decode", b"\x80"), ("ASCIIHexDecode", b"zz")):
        with pytest.raises(PdfError):
            filters.decode(data, [(name, {})])
