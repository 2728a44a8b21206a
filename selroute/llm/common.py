"""Helpers shared by the text operators: byte-bounded batches and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20
LONG_WORD = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, by remainder. A row without an id counts as held out: nothing is learnt from it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text of an Arrow column; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``limit`` bytes (one longer text makes a run of its own), with their first index."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, texts[start:]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of rows of about ``limit`` bytes of text, for results that are worked out and passed on piece by piece."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes + 1) // limit)) + 1).tolist(), len(column)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a or len(column) == 0:
            yield column[a:b]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def find_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, split at ASCII white space: buffer (padded), starts, lengths and the index of each word's text."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    joined = b"\n".join(texts)
    buffer = np.frombuffer(joined + b"\n" + bytes(8), dtype=np.uint8)
    space = _SPACE[buffer[: len(joined) + 1]]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
    return buffer, starts, ends - starts, np.searchsorted(first, starts, side="right") - 1


def hash_words(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; very long words are hashed one by one."""
    wide = np.ndarray((max(len(buffer) - 7, 0),), dtype="<u8", buffer=buffer, strides=(1,))
    h = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    long = lengths > LONG_WORD
    at = np.flatnonzero(~long)
    done = 0
    while len(at):
        piece = wide[starts[at] + done] & _MASKS[np.minimum(lengths[at] - done, 8)]
        h[at] = mix(h[at] ^ piece)
        done += 8
        at = at[lengths[at] > done]
    if long.any():
        data = buffer.tobytes()
        for i in np.flatnonzero(long):
            h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return h


def hash_windows(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and the position of each run's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    whole = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(h[whole]), whole
