"""Text expressions that operators share."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-case runs of letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def sentences(text: Column) -> Column:
    """Stretches that end with a full stop, a question or an exclamation mark, or the text."""
    return F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]*)"), F.lit(1))


@cache
def _is_letter() -> np.ndarray:
    """For each code point. Made once a worker."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)])


@cache
def _letters() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Runs of letters, as \\p{L}+, up to U+FFFF, whose set is one look-up, and of all; and what is beyond. Made once a worker."""
    known = [*_is_letter().tolist(), False]

    def runs(end: int) -> re.Pattern:
        some = [*known[:end], False]
        ends = [i for i in range(len(some)) if some[i] != some[i - 1]]
        return re.compile("[" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(ends[::2], ends[1::2], strict=True)) + "]+")

    return runs(0x10000), runs(len(known)), re.compile("[\U00010000-\U0010ffff]")


def words(texts: pa.Array) -> list[list[str]]:
    """terms() of each text, inside a task: none of null, and bytes that are no UTF-8 part words as they do there."""
    return [word_list(x) for x in _decoded(texts)]


def _decoded(texts: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") if x else "" for x in texts.cast(pa.binary()).to_pylist()]


def word_list(text: str) -> list[str]:
    near, all_, far = _letters()
    text = text.lower()
    return (all_ if far.search(text) else near).findall(text)


def pieces(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """texts in stretches of about ``most`` bytes, each text whole."""
    if len(texts):
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero(np.diff((np.cumsum(size) - size) // most, prepend=-1)).tolist()
        for a, b in zip(at, [*at[1:], len(texts)], strict=True):
            yield texts.slice(a, b - a)


def coded_words(texts: pa.Array, most: int = 1 << 20) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """words() of all texts by their places among the distinct ones: those, the place of each word, and how many words each text has. No string is made
    for a word; ``most`` bytes of text, about, are cut together, as small tables are fast."""
    parts = [_coded(part) for part in pieces(texts, most)] or [_coded(texts)]
    found = pa.chunked_array([x for x, _ in parts]).unify_dictionaries()
    return found.chunk(0).dictionary, np.concatenate([x.indices.to_numpy() for x in found.chunks]).astype(np.int64), np.concatenate([n for _, n in parts])


def _coded(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    low = [x.lower() for x in _decoded(texts)]
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le"), np.uint32)  # a line break ends each text
    begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in low], dtype=np.int64)))
    inside = _is_letter()[points]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    letters, size = points[inside], edge[1::2] - edge[::2]
    width = 1 + (letters > 0x7F).view(np.int8) + (letters > 0x7FF).view(np.int8) + (letters > 0xFFFF).view(np.int8)  # bytes of a letter
    ends = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))[np.concatenate(([0], np.cumsum(size)))]
    text = pa.py_buffer(letters.tobytes().decode("utf-32-le").encode())
    found = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), text]).dictionary_encode()
    return pa.DictionaryArray.from_arrays(found.indices, found.dictionary.cast(pa.string())), np.diff(np.searchsorted(edge[::2], begin))


def words_of_sentences(texts: pa.Array) -> list[list[list[str]]]:
    """terms() of each of the sentences() of each text, inside a task."""
    find = re.compile("[^.!?]+[.!?]*").findall
    return [[word_list(s) for s in find(x)] for x in _decoded(texts)]


def strings(found: list[str]) -> pa.Array:
    """An array of strings without line breaks, made of them joined, which is far faster than one by one."""
    return pc.split_pattern(pa.array(["\n".join(found)]), "\n").flatten() if found else pa.array([], pa.string())
