"""Code 128: code set B for printable ASCII, set C for runs of four digits or more."""

from __future__ import annotations

import re

#: Bar and space widths of values 0 to 105, then the stop pattern (fixed values).
PATTERNS = (
    "212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221 223211 221132 221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 "
    "212123 212321 232121 111323 131123 131321 112313 132113 132311 211313 231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131 311123 311321 331121 312113 312311 332111 "
    "314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114 122411 142112 142211 241211 221114 413111 241112 134111 111242 121142 121241 114212 124112 124211 411212 421112 421211 212141 "
    "214121 412121 111143 111341 131141 114113 114311 411113 411311 113141 114131 311141 411131 211412 211214 211232 2331112"
).split()
START_B, TO_B, TO_C, STOP = 104, 100, 99, 106


def values(text: str) -> list[int]:
    """Code values from the start to the check value. ValueError for other than ASCII 32 to 126."""
    if not all(32 <= ord(c) <= 126 for c in text):
        raise ValueError("unsupported_characters")
    out = [START_B]
    for m in re.finditer(r"\d{4,}|(?:(?!\d{4}).)+", text, re.S):
        part = m[0]
        if re.match(r"\d{4}", part):
            even = len(part) // 2 * 2
            out += [TO_C, *(int(part[k : k + 2]) for k in range(0, even, 2))]
            if m.start() + even < len(text):
                out.append(TO_B)
            out += [ord(c) - 32 for c in part[even:]]
        else:
            out += [ord(c) - 32 for c in part]
    return [*out, checksum(out)]


def checksum(codes: list[int]) -> int:
    return (codes[0] + sum(k * v for k, v in enumerate(codes[1:], 1))) % 103


def encode(text: str) -> list[int]:
    """Widths of bars and spaces in turn, a bar first."""
    return [int(d) for v in [*values(text), STOP] for d in PATTERNS[v]]


def total_modules(text: str) -> int:
    return sum(encode(text))
