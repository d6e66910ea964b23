"""Breaking text into lines."""

from __future__ import annotations

import re
from collections.abc import Callable

SOFT = "\u00ad"
_CHUNK = re.compile(r"\n|[^\s\u200b\u00ad\-]*(?:[ \t\u200b]|\u00ad|-)|[^\s\u200b\u00ad\-]+|\s")


def chunks(text: str) -> list[str]:
    """Pieces that may stand at a line's end: up to and with a space, tab, zero-width space, soft hyphen or hyphen; line breaks alone."""
    return [m[0] for m in _CHUNK.finditer(text)]


def shown(line: str) -> str:
    """A line without soft hyphens inside; one at its end becomes a hyphen."""
    end = "-" if line.endswith(SOFT) else ""
    return line.replace(SOFT, "").replace("\u200b", "") + end


def wrap(text: str, width: float, measure: Callable[[str], float]) -> list[str]:
    """Greedy lines of at most ``width``; a line break ends one, a piece that is too wide has its own, blanks at an end go."""
    out, line, forced = [], "", False
    for c in chunks(text):
        forced = c == "\n"
        if forced:
            out.append(line)
            line = ""
            continue
        if line.strip() and measure(shown((line + c).rstrip(" \t"))) > width:
            out.append(line)
            line = ""
        if not line and out and c.strip() == "":
            continue
        line += c
    if line or forced or not out:
        out.append(line)
    return [shown(x.rstrip(" \t")) for x in out]
