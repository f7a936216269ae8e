"""Text as numpy arrays of code points, shared by the operators of this package."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_NOT_LETTER_OR_DIGIT = re.compile(r"[\W_]+")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def code_points(text: str) -> np.ndarray:
    """The code points of `text` as uint32; lone surrogates are kept."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def joined(texts: list[str], separator: str = "\x00") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with `separator` after each, and the start of each text."""
    lengths = np.fromiter((len(t) + len(separator) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=starts[1:])
    return code_points(separator.join(texts) + separator) if texts else np.zeros(0, dtype="<u4"), starts


def letters_and_digits(text: str) -> str:
    """NFKC, lower case, then only letters and digits of any script."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _NOT_LETTER_OR_DIGIT.sub("", text.lower())


def letters_only(text: str) -> str:
    """NFKC, lower case, then only letters (Han characters included)."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    out = _NOT_LETTER.sub("", text.lower())
    return out if out.isalpha() else "".join(c for c in out if c.isalpha())


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche, over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
