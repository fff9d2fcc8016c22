"""Bytes to text: byte-order marks, coding cookies, wide encodings without a mark, UTF-8, then Latin-1."""

from __future__ import annotations

import codecs
import re

_MARKS = [(codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
_COOKIE = re.compile(rb"coding[:=]\s*([-\w.]+)")


def marked(data: bytes) -> str | None:
    return next((name for mark, name in _MARKS if data.startswith(mark)), None)


def cookie(data: bytes) -> str | None:
    for line in data.split(b"\n", 2)[:2]:
        if m := _COOKIE.search(line):
            try:
                return codecs.lookup(m[1].decode("ascii", "replace")).name
            except LookupError:
                return None
    return None


def wide(data: bytes) -> str | None:
    """The unmarked UTF-16 or UTF-32 encoding that the places of NUL bytes suggest, if it gives mostly ASCII."""
    if len(data) < 4 or b"\0" not in data:
        return None
    names = []
    quads = len(data) // 4
    if sum(data[i : i + 4].count(0) >= 3 for i in range(0, quads * 4, 4)) > 0.8 * quads:
        names += ["utf-32-le", "utf-32-be"]
    even, odd = data[0::2], data[1::2]
    shares = even.count(0) / len(even), odd.count(0) / len(odd)
    if shares[1] > 0.8 and shares[0] < 0.2:
        names.append("utf-16-le")
    if shares[0] > 0.8 and shares[1] < 0.2:
        names.append("utf-16-be")
    best, score = None, 0.8
    for name in names:
        text = data.decode(name, "replace")
        ascii_share = sum(c.isascii() and (c.isprintable() or c.isspace()) for c in text) / max(1, len(text))
        if ascii_share > score:
            best, score = name, ascii_share
    return best


def is_binary(probe: bytes) -> bool:
    return b"\0" in probe and marked(probe) is None and wide(probe) is None


def decode(data: bytes) -> str:
    for name in (marked(data), cookie(data), wide(data), "utf-8"):
        if name:
            try:
                return data.decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
    return data.decode("latin-1")
