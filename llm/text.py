"""Words, lines and spans of whole batches of texts, as numpy arrays over their UTF-8 bytes.

A batch is one byte array with the offsets of its texts, as Arrow holds it. Hashes of spans come
from prefix sums, so a span costs the same whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
# Bytes of a word are all but blanks, or, for decontamination, digits, letters and non-ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C13)
_BACK = U64(pow(0x9E3779B97F4A7C13, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; kept for the next batch of a task."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes: starts, ends, and the text that each run lies in. No run crosses texts."""
    n = len(member)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty(n, bool)
    before[0], before[1:] = False, member[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, member[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums that span_hash subtracts; one more than bytes."""
    out = np.zeros(len(data) + 1, U64)
    np.take(_BYTE, data, out=out[1:])
    out[1:] *= powers(_STEP, len(data))
    return np.cumsum(out, out=out)


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they are."""
    back = powers(_BACK, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * back[starts])


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes; the last k - 1 places hold none and are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = out * _STEP + words[i : i + n]
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Parts of a batch with about ``most`` bytes of text each; a longer text makes a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)
