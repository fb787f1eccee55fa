"""Words and word hashes that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_STEP = 0x9E3779B97F4A7C15
#: Bytes of text whose words a worker holds at a time; a longer text is held whole.
PART_BYTES = 4 << 20


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of characters other than space and \\t to \\r, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashed(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All words of an Arrow array of texts, split and numbered outside of Python: the row and the word number of each, and the distinct words."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    at = flat.indices.to_numpy()
    vocabulary = flat.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in vocabulary:  # what stands before or after leading and trailing space
        keep = at != vocabulary.index(b"")
        row, at = row[keep], at[keep]
    return row, at, vocabulary


def parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """An array of texts in slices of about ``most`` bytes, each at least one text, with the place of their first."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, texts.take(pa.array(np.arange(at, upto)))  # a copy: some Arrow kernels misread a slice that was cast
        at = upto


def hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of the words of each text, as :func:`hashed` of :func:`words` gives them."""
    for _, part in parts(texts):
        row, at, vocabulary = tokens(pc.ascii_lower(part.cast(pa.large_string())))
        flat = hashed(vocabulary)[at]
        bounds = np.searchsorted(row, np.arange(len(part) + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield flat[a:b]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit depends on every other."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order: polynomials put together from runs of 1, 2, 4, ... words."""
    if len(h) < n or n < 1:
        return np.empty(0, np.uint64)
    run, width, out, done = mixed(h + np.uint64(_STEP)), 1, None, 0
    while True:
        power = np.uint64(pow(_STEP, width, 1 << 64))
        if n & width:
            if out is None:
                out = run
            else:
                m = len(h) - done - width + 1
                out = out[:m] * power + run[done : done + m]
            done += width
        if done == n:
            return mixed(out)
        run = run[: len(run) - width] * power + run[width:]
        width *= 2
