"""Word shingles as 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

K = 5
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads nearby values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array, lower=pc.utf8_lower) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, laid end to end, and the texts' offsets in them. Null counts as empty."""
    words = pc.ascii_split_whitespace(lower(texts.fill_null("")))
    offsets = np.asarray(words.offsets, dtype=np.int64)
    flat = words.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    coded = flat.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    kept = np.concatenate([[0], np.cumsum(full)])
    return hashes[np.asarray(coded.indices)[full]] if len(flat) else np.zeros(0, np.uint64), kept[offsets - offsets[0]]


def shingles(words: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text (of all its words if it has fewer; none if it has none), and offsets."""
    sizes = np.diff(offsets)
    counts = np.where(sizes == 0, 0, np.maximum(sizes - k + 1, 1))
    ends = np.cumsum(counts)
    at = np.repeat(offsets[:-1] - (ends - counts), counts) + np.arange(int(counts.sum()))
    last = np.repeat(offsets[1:] - 1, counts)
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        place = at + j
        out = out * PRIME + np.where(place <= last, words[np.minimum(place, last)], np.uint64(0)) if len(at) else out
    return mix(out), np.concatenate([[0], ends])
