"""BagMinHash signatures: components of two bags agree with the probability of their weighted Jaccard similarity.

An element of weight w owns the strip (0, w] of a plane of heights and times. Heights are cut into
(0, 1], (1, 2], (2, 4], (4, 8] ...; in each a Poisson process, seeded by the element and the strip,
deals points with a time, a height and a component. A component's value is the time of its earliest
point at or below w. Bags share the points below the smaller of two weights.
"""

from __future__ import annotations

import math

import numpy as np

from strataloom.llm.words import U64, mix, salted

TO_UNIT = 1.0 / (1 << 53)


def _unit(bits: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((bits >> U64(11)).astype(np.float64) + 0.5) * TO_UNIT


def _points(seeds: np.ndarray, weights: np.ndarray, low: float, high: float, size: int, until: float, out: np.ndarray) -> None:
    """Lower the components in `out` by the points of one strip up to the time `until`."""
    rate = high - low
    first = -np.log(_unit(mix(seeds))) / rate
    live = np.flatnonzero(first <= until)
    at = 0
    mean = rate * until
    draws = int(mean + 1.5 * math.sqrt(mean)) + 2
    while at < len(live):
        pick = live[at : at + max(1, 200_000 // draws)]
        at += len(pick)
        start, step = np.zeros(len(pick)), 0
        rows = np.arange(len(pick))
        while len(rows):
            number = U64(2) * np.arange(step, step + draws, dtype=U64)
            s = seeds[pick[rows]][:, None]
            times = start[rows][:, None] + np.cumsum(-np.log(_unit(mix(s + number * U64(0x9E3779B97F4A7C15)))) / rate, axis=1)
            more = mix(s + (number + U64(1)) * U64(0x9E3779B97F4A7C15))
            height = low + (high - low) * ((more >> U64(32)).astype(np.float64) + 0.5) / 2.0**32
            good = (times <= until) & (np.ceil(height) <= weights[pick[rows]][:, None])
            slot = ((more & U64(0xFFFFFFFF)) * U64(size)) >> U64(32)
            np.minimum.at(out, slot[good].astype(np.int64), times[good])
            start[rows] = times[:, -1]
            rows = rows[times[:, -1] <= until]
            step += draws


def signature(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """`size` 64-bit values of a bag of distinct elements with whole weights; the bag must not be empty."""
    total = float(weights.sum())
    until = size / total * (math.log(size) + 4)
    strips = int(math.ceil(math.log2(weights.max()))) + 1 if weights.max() > 1 else 1
    seeds = []
    for k in range(strips):
        low, high = (0.0, 1.0) if k == 0 else (2.0 ** (k - 1), 2.0**k)
        own = weights > low
        seeds.append((salted(elements[own], k + 1), weights[own], low, high))
    while True:
        out = np.full(size, np.inf)
        for s, w, low, high in seeds:
            _points(s, w, low, high, size, until, out)
        if np.isfinite(out).all():
            return out.view(U64)
        until *= 2

