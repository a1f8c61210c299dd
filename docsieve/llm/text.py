"""Words and hashes that the text operators share."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a maximal run of Unicode letters and digits.
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text, in order; none for a null text."""
    return WORD.findall(text.lower()) if text else []


@cache
def word_points() -> np.ndarray:
    """For each code point, whether words consist of it."""
    inside = np.zeros(0x110000, bool)
    for m in WORD.finditer("".join(map(chr, range(0x110000)))):
        inside[m.start() : m.end()] = True
    return inside


def words_at(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of texts in lower case, as ``WORD`` finds them, one text after the other; where each begins in its text; the number of words of each text."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    inside = word_points()[points]
    points[~inside] = 32
    words = points.tobytes().decode("utf-32-le", "surrogatepass").split()
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    owner = np.searchsorted(begins, starts, side="right") - 1
    return words, starts - begins[owner], np.bincount(owner, minlength=len(texts))


class WordHashes(dict):
    """64-bit hash of each word seen, computed once per distinct word."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def squeezed(column: Column | str) -> Column:
    """A text in lower case, reduced to its letters and digits; '' for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def distinct_words(*columns: str) -> Column:
    """The distinct words of several text columns together, as an array."""
    joined = F.lower(F.concat_ws(" ", *columns))
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def named_apart(taken: list[str], *wanted: str) -> list[str]:
    """Working names derived from ``wanted`` that clash with none of ``taken`` (case is ignored)."""
    used, names = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        names.append(name)
    return names
