import time

import numpy as np
import pytest
from foliospark.codes import code128, qr, shaped


def test_code128_values():
    assert code128.values("Wikipedia")[-1] == 88
    assert code128.values("AB1234C12345") == [104, 33, 34, 99, 12, 34, 100, 35, 99, 12, 34, 100, 21, 37]
    assert code128.values("1234A1234")[:8] == [104, 99, 12, 34, 100, 33, 99, 12]
    assert code128.values("123")[:4] == [104, 17, 18, 19]
    assert code128.total_modules("A") == 11 * 3 + 13 == sum(code128.encode("A"))
    with pytest.raises(ValueError):
        code128.encode("é")


def test_patterns_are_sound():
    assert len(code128.PATTERNS) == 107 and len(set(code128.PATTERNS)) == 107
    assert all(sum(map(int, p)) == 11 and sum(map(int, p[::2])) % 2 == 0 for p in code128.PATTERNS[:-1])


def decode_bars(widths):
    index = {p: v for v, p in enumerate(code128.PATTERNS)}
    s = "".join(map(str, widths))
    codes, k = [], 0
    while s[k : k + 7] != code128.PATTERNS[106]:
        codes.append(index[s[k : k + 6]])
        k += 6
    assert codes[-1] == code128.checksum(codes[:-1])
    out, mode = "", "b"
    for v in codes[1:-1]:
        if mode == "b" and v == 99:
            mode = "c"
        elif mode == "c" and v == 100:
            mode = "b"
        else:
            out += chr(v + 32) if mode == "b" else f"{v:02d}"
    return out


@pytest.mark.parametrize("text", ["A", "1234", "12345", "a1234b56c", "0000000", "x 12 y 123456 z", "~!"])
def test_bars_decode(text):
    assert decode_bars(code128.encode(text)) == text


@pytest.mark.parametrize("shape", [*shaped.available_shapes(), None])
def test_shapes(shape):
    got = shaped.encode("BUNNY", shape=shape)
    bars = sum(1 for k, _ in enumerate(code128.encode("BUNNY")) if k % 2 == 0)
    assert 0 < len(got["bars"]) <= bars
    assert all(-1e-9 <= b["x"] and b["x"] + b["w"] <= 1 + 1e-9 and b["h"] > 0 for b in got["bars"])
    if got["region"]:
        x, y, w, h = got["region"]
        assert len(got["bars"]) == bars and all(x <= b["x"] and b["x"] + b["w"] <= x + w + 1e-9 for b in got["bars"])


def test_contours():
    assert shaped.interpolate([(0, 0), (1, 2)], 0.25) == 0.5
    assert shaped.interpolate([], 0.3) == 1.0 and shaped.interpolate([(0.5, 3)], 0) == 3 and shaped.interpolate([(0.2, 1), (0.4, 2)], 0.9) == 2
    got = shaped.encode("AB", contour_top=[(0, 0.5), (1, 0.5)], contour_bottom=[(0, 0.1)], bar_min=0.7)
    assert {round(b["h"], 6) for b in got["bars"]} == {0.6}


def read_qr(rows):
    """A decoder of its own: format, mask, codewords, blocks with zero syndromes, byte mode."""
    m = np.array(rows, np.uint8)
    n = len(m)
    version = (n - 17) // 4
    f = sum(int(m[r, 8]) << k for k, r in enumerate([0, 1, 2, 3, 4, 5, 7, 8])) | sum(int(m[8, c]) << k for k, c in zip(range(8, 15), [7, 5, 4, 3, 2, 1, 0], strict=True))
    other = sum(int(m[8, n - 1 - k]) << k for k in range(8)) | sum(int(m[n - 15 + k, 8]) << k for k in range(8, 15))
    assert f == other
    (level, mask), = [(lv, k) for lv in qr.EC for k in range(8) if qr.format_bits(lv, k) == f]
    _, used = qr._frame(version)
    m = np.where(qr.masked(mask, n) & ~used, m ^ 1, m)
    bits = [int(m[r, c]) for r, c in qr._path(n) if not used[r, c]]
    words = [int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, qr.raw_codewords(version) * 8, 8)]
    ec, blocks = qr.EC[level][0][version - 1], qr.EC[level][1][version - 1]
    total = qr.data_codewords(version, level)
    sizes = [total // blocks + (b >= blocks - total % blocks) for b in range(blocks)]
    own, k = [[] for _ in sizes], 0
    for i in range(max(sizes)):
        for b, s in enumerate(sizes):
            if i < s:
                own[b].append(words[k])
                k += 1
    checks = [[words[total + i * blocks + b] for i in range(ec)] for b in range(blocks)]
    exp, log = qr._field()
    for d, c in zip(own, checks, strict=True):
        for j in range(ec):
            s = 0
            for w in d + c:
                s = (exp[log[s] + j] if s else 0) ^ w
            assert s == 0
    data = "".join(f"{w:08b}" for d in own for w in d)
    assert data[:4] == "0100"
    head = 8 if version < 10 else 16
    size = int(data[4 : 4 + head], 2)
    return level, version, bytes(int(data[4 + head + 8 * i : 12 + head + 8 * i], 2) for i in range(size))


@pytest.mark.parametrize("level", "LMQH")
@pytest.mark.parametrize("size", [0, 1, 7, 20, 60, 130, 250, 380])
def test_qr_decodes(level, size):
    text = ("https://example.org/ñ?" * 30)[: min(size, 360)]
    got = read_qr(qr.encode(text, level))
    assert got[0] == level and got[2] == text.encode() and got[1] == qr.min_version(len(text.encode()), level)


def test_qr_limits_and_frame():
    assert qr.capacity(1, "L") == 17 and qr.capacity(20, "L") == 858 and qr.capacity(10, "H") == 119
    assert qr.alignment(7) == [6, 22, 38] and qr.alignment(20) == [6, 34, 62, 90]
    with pytest.raises(ValueError):
        qr.encode("x" * 859, "L")
    m = qr.encode("A", "Q")
    assert len(m) == 21 and m[0][:7] == [1] * 7 and m[13][8] == 1
    assert qr.remainder([32, 91, 11, 120, 209, 114, 220, 77, 67, 64, 236, 17, 236, 17, 236, 17], 10) == [196, 35, 39, 119, 235, 215, 231, 226, 93, 23]


def test_symbols_made_together():
    texts = ["Customer#000000001", None, "", "x" * 5000, "é" * 40, *(f"Customer#{k:09d}" for k in range(2000)), "y" * 660]
    began = time.process_time()
    made = qr.encode_all(texts)
    assert time.process_time() - began < 4  # one by one they took over 10
    assert [k for k, m in enumerate(made) if m is None] == [1, 3]
    assert all(m.tolist() == qr.encode(t) for t, m in zip(texts[:40], made, strict=False) if m is not None)
    assert all(read_qr(made[k].tolist())[2] == t.encode() for k, t in ((0, texts[0]), (4, texts[4]), (-1, texts[-1])))


def test_symbols_as_a_column(spark):
    from foliospark.functions import codes

    rows = spark.createDataFrame([(1, "AB"), (2, None), (3, "z" * 5000), (4, "é" * 30)], "k int, t string").coalesce(1)
    got = {r.k: r.m for r in rows.select("k", codes.qr_modules("t").alias("m")).collect()}
    assert got == {1: qr.encode("AB"), 2: None, 3: None, 4: qr.encode("é" * 30)}
    assert rows.limit(0).select(codes.qr_modules("t")).collect() == []
