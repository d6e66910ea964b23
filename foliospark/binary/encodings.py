"""Byte encodings and glyph names, as far as possible from rules: Python's codecs and Unicode's names."""

from __future__ import annotations

import functools
import re
import unicodedata

#: Where StandardEncoding differs from ASCII (fixed values): code to character.
STANDARD_EXTRA = {
    0x27: "’", 0x60: "‘", 0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "ﬁ", 0xAF: "ﬂ",
    0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘",
    0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}


@functools.cache
def table(name: str | None) -> tuple[str | None, ...]:
    """256 characters of an encoding; None where it has none. An unknown name has none at all."""
    if name == "WinAnsiEncoding":
        out = [bytes([b]).decode("cp1252", "ignore") or None for b in range(256)]
        return tuple("•" if b > 31 and c is None else c for b, c in enumerate(out))
    if name == "MacRomanEncoding":
        return tuple(bytes([b]).decode("mac_roman") for b in range(256))
    if name == "StandardEncoding":
        return tuple(STANDARD_EXTRA.get(b, chr(b) if 32 <= b < 127 else None) for b in range(256))
    return (None,) * 256


#: Glyph names that neither are a Unicode name nor follow a rule below (fixed values).
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-",
    "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_",
    "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©",
    "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º",
    "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß", "multiply": "×",
    "divide": "÷", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜",
    "hungarumlaut": "˝", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•",
    "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "minus": "−", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "nbspace": " ",
    "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "infinity": "∞", "partialdiff": "∂", "summation": "∑", "product": "∏", "radical": "√", "integral": "∫", "approxequal": "≈", "lozenge": "◊", "onesuperior": "¹",
    "twosuperior": "²", "threesuperior": "³", "softhyphen": "­",
}
_DIGITS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True))
#: The mark that the ending of a glyph name stands for, as Unicode names it.
_MARKS = {"grave": "GRAVE", "acute": "ACUTE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "macron": "MACRON", "breve": "BREVE", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE", "commaaccent": "CEDILLA", "croat": "STROKE"}
_GREEK = set("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split())


@functools.lru_cache(maxsize=8192)
def glyph(name: str) -> str | None:
    """The text of a glyph name, or None: fixed names, uniXXXX and uXXXXX, letters with a mark, Greek; a suffix behind a dot is left out."""
    base = name.split(".", 1)[0] if not name.startswith(".") else name
    if base in GLYPHS:
        return GLYPHS[base]
    if base in _DIGITS:
        return _DIGITS[base]
    if len(base) == 1:
        return base
    if re.fullmatch(r"uni(?:[0-9A-F]{4})+", base):
        return "".join(chr(int(base[k : k + 4], 16)) for k in range(3, len(base), 4))
    if re.fullmatch(r"u[0-9A-F]{4,6}", base) and int(base[1:], 16) < 0x110000:
        return chr(int(base[1:], 16))
    if "_" in base.strip("_"):
        parts = [glyph(x) for x in base.split("_")]
        return None if None in parts else "".join(parts)
    if base.lower() in _GREEK and (base.islower() or base.istitle()):
        return unicodedata.lookup(f"GREEK {'CAPITAL' if base[0].isupper() else 'SMALL'} LETTER {'LAMDA' if base.lower() == 'lambda' else base.upper()}")
    for end, mark in _MARKS.items():
        if base.endswith(end) and len(base) == len(end) + 1 and base[0].isalpha():
            try:
                return unicodedata.lookup(f"LATIN {'CAPITAL' if base[0].isupper() else 'SMALL'} LETTER {base[0].upper()} WITH {mark}")
            except KeyError:
                return None
    return None


def differences(items: list) -> dict[int, str]:
    """Code to glyph name: numbers set the place, names take it and move on."""
    out, at = {}, 0
    for x in items:
        if isinstance(x, (int, float)):
            at = int(x)
        elif isinstance(x, str):
            out[at] = str(x)
            at += 1
    return out
