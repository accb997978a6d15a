"""Bit-sliced Hamming distances: planes of bits, one distance a bit position, counted together by carry-save counters."""

from __future__ import annotations

import numpy as np

BITS = 64


def bit_planes(values: list[int], bits: int = BITS) -> list[int]:
    """Plane k has bit i set if fingerprint i has bit k set."""
    raw = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(np.packbits(raw[:, k], bitorder="little").tobytes(), "little") for k in range(bits)]


def within_radius(planes: list[int], everyone: int, query: int, radius: int = 2) -> int:
    """The fingerprints (bit i for i) that differ from ``query`` in at most ``radius`` bits.

    All distances advance together, plane by plane, in carry-save counters: counter c holds bit c of every distance.
    Who passes the radius leaves; a block is abandoned once nobody is left.
    """
    counters = [0] * (radius + 1).bit_length()
    alive = everyone
    for k, plane in enumerate(planes):
        carry = (plane ^ everyone if query >> k & 1 else plane) & alive
        for c, value in enumerate(counters):
            counters[c], carry = value ^ carry, value & carry
            if not carry:
                break
        if k >= radius:
            over = everyone
            for c, value in enumerate(counters):
                over &= value if (radius + 1) >> c & 1 else ~value
            alive &= ~over
            if not alive:
                return 0
    return alive


def pairs_within(x: np.ndarray, y: np.ndarray, radius: int, block: int = 4096) -> np.ndarray:
    """Which of the pairs (x[i], y[i]) differ in at most ``radius`` bits: all distances of a block advance together."""
    out = np.zeros(len(x), bool)
    differing = x ^ y
    for at in range(0, len(x), block):
        part = differing[at : at + block]
        alive = within_radius(bit_planes(part), (1 << len(part)) - 1, 0, radius)
        raw = np.frombuffer(alive.to_bytes((len(part) + 7) // 8, "little"), np.uint8)
        out[at : at + len(part)] = np.unpackbits(raw, bitorder="little")[: len(part)]
    return out
