"""Fast similarity sketching of sets of 64-bit hashes.

A sketch has ``t`` coordinates. In round i < t every element is thrown into one of the t bins by a hash of that round; in
round t + j every element goes to bin j. A bin keeps the smallest value of the first round that reached it, so after at
most 2 t rounds every coordinate is filled, mostly after two or three. Two sets agree in a coordinate with a
probability equal to their Jaccard similarity, and the number of agreements is concentrated at least as well as with t
independent minima.
"""

from __future__ import annotations

import numpy as np

from .words import U, mixed

EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """(len(sets), t) coordinates; a set without elements gets EMPTY throughout."""
    out = np.full((len(sets), t), EMPTY, dtype=np.uint64)
    if not sets:
        return out
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if not len(x):
            break
        h = mixed(x + U((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        cell = owner * t + (((h >> U(32)) * U(t)) >> U(32)).astype(np.int64) if i < t else owner * t + (i - t)
        free = flat[cell] == EMPTY
        if free.any():
            value = np.minimum(mixed(h[free] ^ U(0x2545F4914F6CDD1D)), EMPTY - U(1))
            np.minimum.at(flat, cell[free], value)
        left = (out == EMPTY).any(axis=1)
        keep = left[owner]
        if not keep.all():
            x, owner = x[keep], owner[keep]
    return out


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates."""
    n, t = sketches.shape
    parts = sketches.reshape(n, t // rows, rows)
    key = np.zeros((n, t // rows), dtype=np.uint64)
    for r in range(rows):
        key = mixed(key * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key
