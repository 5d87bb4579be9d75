"""Fast text splitting: a tokenizer's pattern for Python's ``re``."""

from __future__ import annotations

import re
import string
import sys
from collections.abc import Callable
from functools import lru_cache

import numpy as np

_CLASSES = (r"\p{L}", r"\p{N}", r"\s", r"\S")


def every_character() -> str:
    return "".join(chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF)


def _up_to(last: int, characters: str) -> str:
    return "".join(c for c in characters if ord(c) <= last)


def _ranges(characters: str) -> str:
    points = np.sort(np.frombuffer(characters.encode("utf-32-le"), "<u4"))
    cut = np.flatnonzero(np.diff(points) != 1)
    starts, ends = points[np.r_[0, cut + 1]], points[np.r_[cut, len(points) - 1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts.tolist(), ends.tolist()))


#: The last character of Unicode's first plane.
FIRST_PLANE = 0xFFFF


@lru_cache(maxsize=8)
def written_out(pattern: str, class_members: Callable[[str], str], last: int = sys.maxunicode) -> str:
    """The pattern with its letter, number and blank classes written out as ranges.

    ``class_members`` names the characters of a class as the tokenizer's own library sees them;
    libraries differ in their editions of Unicode. ``re`` is several times faster than ``regex``.
    The pattern holds for texts without characters beyond ``last``.
    """
    found = re.findall(r"\\[pP]\{\w+\}|\\.", pattern)
    if odd := [c for c in found if c not in _CLASSES and re.match(r"\\[a-zA-Z]", c)]:
        raise ValueError(f"classes not known here: {odd}")
    inside = {c: _ranges(_up_to(last, class_members(c.replace("S", "s")))) for c in set(found) & set(_CLASSES)}
    out, in_brackets = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in inside:
            if in_brackets and part == r"\S":
                raise ValueError("a negated class within brackets")
            negated = "^" if part == r"\S" else ""
            part = inside[part] if in_brackets else f"[{negated}{inside[part]}]"
        elif part in "[]":
            in_brackets = part == "["
        out.append(part)
    return "".join(out)


def splitter(narrow: str, wide: str) -> Callable[[str], list[str]]:
    """Pieces of a text by one pattern written out up to the first plane's end and as a whole.

    ``re`` looks characters of the first plane up in a table and tries ranges beyond it one by one,
    hundreds of them wherever a class does not fit. So only texts with such characters pay for these.
    """
    by_table, by_ranges, end = re.compile(narrow).findall, re.compile(wide).findall, chr(FIRST_PLANE)

    def split(text: str) -> list[str]:
        return by_table(text) if text.isascii() or max(text) <= end else by_ranges(text)

    return split


class Recent(dict):
    """A cache of bounded size: when it is full it becomes the older generation of a new one."""

    def __init__(self, make: Callable[[str], bytes], size: int, longest: int = 64):
        super().__init__()
        self._make, self._size, self._longest, self._older = make, size, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= self._longest:
            if len(self) >= self._size:
                self._older = dict(self)
                self.clear()
            self[key] = value
        return value


def keeps_words(split: Callable[[str], list[str]]) -> bool:
    """Whether a pattern leaves ASCII letters and the space before them in one piece."""
    return split(" " + string.ascii_letters) == [" " + string.ascii_letters]


class _CutsElsewhere(Exception):
    """A blank stands beside a space, so the text can't be cut there."""


class ChunkedEncoder:
    """Encodes texts whose tokenizer never reaches across a single space between other characters.

    That holds for patterns of pieces like `` ?letters`` and runs of blanks: the piece before such a
    space ends there. Texts are cut at these spaces, ids (as bytes) of what lies between are
    remembered, and ``encode`` runs just for the rest. A space beside another blank is no cut.

    ``word`` encodes ASCII letters with the space before them, where the pattern leaves these whole;
    ``marks`` the ASCII punctuation that ends a chunk after such letters (None: encode both as one).
    """

    def __init__(
        self,
        encode: Callable[[str], bytes],
        size: int = 150_000,
        word: Callable[[str], bytes] | None = None,
        marks: Callable[[str], bytes | None] | None = None,
    ):
        self._encode, self._word = encode, word
        self._marks = Recent(marks, size // 8).__getitem__ if marks else None
        self._cut = re.compile(r"(?<!\s) (?!\s)")
        #: Ids of what stands after a space and holds no blank at its ends.
        self.after_space = Recent(self._chunk, size).__getitem__

    def _chunk(self, chunk: str) -> bytes:
        if self._word and chunk.isascii() and chunk.isalpha():
            return self._word(chunk)
        if self._marks:
            letters = chunk.rstrip(string.punctuation)
            if len(letters) < len(chunk) and letters.isascii() and letters.isalpha():
                behind = self._marks(chunk[len(letters) :])
                if behind is not None:
                    return self.after_space(letters) + behind
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _CutsElsewhere
        return self._encode(" " + chunk)

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace():
                raise _CutsElsewhere
            tail = b"".join(map(self.after_space, rest))
        except _CutsElsewhere:
            first, *rest = self._cut.split(text)
            tail = b"".join(
                self._encode(" " + c) if not c or c[0].isspace() or c[-1].isspace() else self.after_space(c)
                for c in rest
            )
        return self._encode(first) + tail
