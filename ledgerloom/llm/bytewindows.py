"""Whole texts as fixed-length windows of bytes, for classifiers."""

from __future__ import annotations

import numpy as np


def windows(texts: list[bytes], length: int, overlap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of ``length`` bytes, index of each one's text, its own bytes). Zeros fill the last window of a text;
    windows start ``length - overlap`` bytes apart, so every byte is in one. An empty text has one empty window."""
    step = length - overlap
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-(sizes - overlap) // step))
    flat = b"".join(t.ljust(c * step + overlap, b"\0") for t, c in zip(texts, counts.tolist()))
    data = np.frombuffer(flat, dtype=np.uint8)
    of = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    spans = counts * step + overlap
    at = np.repeat(np.cumsum(spans) - spans, counts) + nth * step
    cut = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    return cut, of, np.clip(np.repeat(sizes, counts) - nth * step, 0, length)
