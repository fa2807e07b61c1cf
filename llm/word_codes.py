"""The words of a batch of texts as numbers: equal words, and only those, have equal numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from llm import text as T


@dataclass
class Words:
    """Words of several texts one after another; word i of text t has place ``first[t] + i``."""

    codes: np.ndarray  # the number of each word
    known: pa.Array  # the bytes of the word of each number
    first: np.ndarray  # per text, and one more for the end

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def word_codes(column) -> Words:
    """Words are runs of bytes other than blanks; null has none. Codes are exact, not hashes."""
    data, offsets = T.buffer(column)
    member = T.NOT_BLANK[data]
    starts, ends, texts = T.spans(member, offsets)
    plain = np.ascontiguousarray(data[member])
    stops = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=stops[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(stops), pa.py_buffer(plain)])
    coded = words.dictionary_encode()
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(texts, minlength=len(offsets) - 1), out=first[1:])
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary, first)


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Each text again, of its kept words with one space between them."""
    codes = words.codes[keep]
    data, offsets = T.buffer(words.known)
    size = np.diff(offsets)[codes] + 1  # with the space after it
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    out = np.full(total, 32, np.uint8)
    inside = np.ones(total, bool)
    inside[stop - 1] = False
    source = np.arange(total) - np.repeat(stop - size - offsets[:-1][codes], size)
    out[inside] = data[source[inside]]
    texts = np.repeat(np.arange(len(words.first) - 1), words.count)[keep]
    per_text = np.bincount(texts, weights=size, minlength=len(words.first) - 1).astype(np.int64)
    ends = np.zeros(len(words.first), np.int64)
    np.cumsum(per_text, out=ends[1:])
    # The last word of a text has no space after it.
    full = np.flatnonzero(per_text)
    spare = np.ones(total, bool)
    spare[ends[full + 1] - 1] = False
    offsets = ends - np.concatenate([[0], np.cumsum(per_text > 0)])
    return pa.LargeStringArray.from_buffers(len(words.first) - 1, pa.py_buffer(offsets), pa.py_buffer(out[spare]))
