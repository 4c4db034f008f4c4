"""Counts of a whole text that several operators share; bytes in, numbers out.

A word is a run of anything but space, tab, line feed, vertical tab, form feed
and carriage return, as ``bytes.split`` has it.
"""

from __future__ import annotations

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that continue a code point


def word_chars(text: bytes) -> int:
    """Code points in words."""
    return len(text.translate(None, SPACE + _INSIDE))


def n_of(text: bytes, signs: bytes) -> int:
    return len(text) - len(text.translate(None, signs))


def lines_with_words(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x and not x.isspace()]


def window_codes(words: list[bytes], width: int) -> np.ndarray:
    """A number for each window of ``width`` words; equal windows have equal numbers."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n, bits = len(ids) - width + 1, max(1, len(known).bit_length())
    codes, held = ids[:n], bits
    for k in range(1, width):
        if held + bits > 62:  # more distinct words than fit side by side: number the windows so far
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
            held = max(1, n.bit_length())
        codes, held = codes << bits | ids[k : n + k], held + bits
    return codes


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that occur twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    codes = window_codes(words, width)
    ordered = np.sort(codes)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    at = np.flatnonzero(np.isin(codes, ordered[1:][same]))
    within = np.zeros(n, bool)
    for k in range(width):
        within[at + k] = True
    return int(within.sum())
