"""SetSketch registers: exponentially spaced, truncated minima of a set's hashes.

Register i of a set holds ``clip(floor(1 - log_b(min_x E_i(x))), 0, q + 1)``, where E_i(x) is an
exponential variable of rate ``a`` derived from element x by the i-th hash. The register of
a union is the larger of both registers, so sketches merge; two sets agree in a register
with a probability that rises with their Jaccard similarity, so groups of registers band.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from rowloom.llm.textkit import stream

_U = np.uint64


@dataclass(frozen=True)
class SketchSpec:
    bands: int = 24
    rows: int = 6
    base: float = 1.02
    rate: float = 20.0
    top: int = 2000  # q: covers sets of up to about 1e15 elements at this base

    @property
    def m(self) -> int:
        return self.bands * self.rows


@lru_cache
def _hashes(m: int) -> tuple[np.ndarray, np.ndarray]:
    return stream(m, 71) | _U(1), stream(m, 72)


def sketch(elements: np.ndarray, spec: SketchSpec) -> np.ndarray:
    """The m registers (uint16) of one set of 64-bit element hashes; an empty set gives zeros."""
    if not len(elements):
        return np.zeros(spec.m, dtype=np.uint16)
    scale, shift = _hashes(spec.m)
    low = np.full(spec.m, np.iinfo(np.uint64).max, dtype=_U)
    for at in range(0, len(elements), 512):
        np.minimum(low, (elements[at : at + 512, None] * scale + shift).min(axis=0), out=low)
    return registers(low, spec)


def registers(low: np.ndarray, spec: SketchSpec) -> np.ndarray:
    """Register values from the least uniform hash in each position."""
    uniform = (low.astype(np.float64) + 1.0) / 2.0**64
    with np.errstate(divide="ignore"):
        least = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / spec.rate
        value = np.floor(1.0 - np.log(least) / np.log(spec.base))
    return np.clip(value, 0, spec.top + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likely_jaccard(above, below, same, size_a, size_b, base: float) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, given how many registers of a are above,
    below and equal to those of b and both set sizes. All arguments are arrays of pairs.

    With u and v the shares of both sizes, a register of a is above with probability
    p(u - v J) and below with p(v - u J), p(x) = -log_b(1 - x (b - 1) / b). The likelihood has
    one peak in J, found by golden-section search on [0, min(u/v, v/u)].
    """
    u = size_a / (size_a + size_b)
    v = 1.0 - u
    log_b, slope, tiny = np.log(base), (base - 1.0) / base, 1e-300

    def p(x):
        return np.maximum(-np.log1p(-np.maximum(x, 0.0) * slope) / log_b, 0.0)

    def fit(j):
        up, down = p(u - v * j), p(v - u * j)
        return (
            above * np.log(np.maximum(up, tiny))
            + below * np.log(np.maximum(down, tiny))
            + same * np.log(np.maximum(1.0 - up - down, tiny))
        )

    gold = (np.sqrt(5.0) - 1.0) / 2.0
    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    x, y = hi - gold * (hi - lo), lo + gold * (hi - lo)
    fx, fy = fit(x), fit(y)
    for _ in range(32):
        right = fx < fy
        lo, hi = np.where(right, x, lo), np.where(right, hi, y)
        x, y = hi - gold * (hi - lo), lo + gold * (hi - lo)
        fx, fy = fit(x), fit(y)
    return (lo + hi) / 2.0
