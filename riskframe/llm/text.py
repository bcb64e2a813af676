"""Text pieces shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: a word is a run of anything but these six characters
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """Array of the words of a text; NULL and empty texts have none."""
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def word_count(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def id_remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; NULL ids count as the text of nothing."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


SPACES = b" \t\n\x0b\x0c\r"


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one behind the other, and where each begins and the last ends; NULL is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return raw, bounds - bounds[0]


def distinct(letters: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, number of each word) of words that follow each other in ``letters``."""
    letters, cuts = np.ascontiguousarray(letters), np.ascontiguousarray(cuts, np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
    # slices of one buffer: Arrow makes Python values one by one, which takes longer than all the rest
    cuts = np.frombuffer(found.dictionary.buffers()[1], np.int64)[:len(found.dictionary) + 1].tolist()
    joined = found.dictionary.buffers()[2].to_pybytes() if found.dictionary.buffers()[2] else b""
    return [joined[i:j] for i, j in zip(cuts, cuts[1:])], found.indices.to_numpy().astype(np.int64)


def split_words(texts: pa.Array, spaces: bytes = SPACES, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, word numbers of all texts in order, where each text's words begin and the last one's end).

    Words are runs of bytes that are not in ``spaces``; ``lower`` changes A-Z only.  NULL has no words.
    """
    raw, bounds = text_bytes(texts)
    if not len(raw):
        return [], np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = np.ones(256, bool)
    inside[list(spaces)] = False
    kept = inside[raw]
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    edge = bounds[(bounds > 0) & (bounds < len(raw))]  # a word ends where its text ends
    first[edge] = kept[edge]
    letters = raw[kept]
    if lower:
        small = np.arange(256, dtype=np.uint8)
        small[65:91] += 32
        letters = small[letters]
    words, numbers = distinct(letters, np.append(np.flatnonzero(first[kept]), len(letters)))
    return words, numbers, np.searchsorted(np.flatnonzero(first), bounds)


def scalar_row(df: DataFrame):
    """The only row of an aggregate."""
    return df.first()
