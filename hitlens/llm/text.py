"""Helpers that the operators' Python workers share."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa

#: Words of every operator here: runs of bytes other than space and \\t \\n \\v \\f \\r, as bytes.split() cuts them.
WORD = r"[^\x20\x09-\x0D]+"


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for models that many tasks use."""
    return sys.__dict__.setdefault("_hitlens_llm_cache", {})


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def word_bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in b" ".join(words)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return ends - sizes, ends


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """All runs of k words, space-joined, repeats included; fewer words: the whole sequence; none: nothing."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [joined]
    starts, ends = word_bounds(words)
    return [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
