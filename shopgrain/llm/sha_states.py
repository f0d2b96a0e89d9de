"""SHA-256 over many inputs at once, with states that can be kept and resumed.

A state is eight 32-bit words. Children enter a parent as hexadecimal text of 64 bytes, which is one block of the hash,
so the state before each child is a row of words that can be stored, copied and resumed. Arrays have one row per hash.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

MASK = 0xFFFFFFFF


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** 3 <= n else (low, middle - 1)
    return low


# First 32 bits of the fractions of square roots and of cube roots of primes.
START = np.array([isqrt(p << 64) & MASK for p in _primes(8)], np.uint32)
ROUND = [np.uint32(_cube_root(p << 96) & MASK) for p in _primes(64)]
HEX_PAIRS = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states after one more block of sixteen words each."""
    w = [np.ascontiguousarray(blocks[:, k]) for k in range(16)]
    a, b, c, d, e, f, g, h = first = [np.ascontiguousarray(states[:, k]) for k in range(8)]
    for k in range(64):
        if k >= 16:
            early, late = w[(k - 15) % 16], w[(k - 2) % 16]
            w[k % 16] = (
                w[k % 16] + (_turn(early, 7) ^ _turn(early, 18) ^ (early >> np.uint32(3))) + w[(k - 7) % 16]
                + (_turn(late, 17) ^ _turn(late, 19) ^ (late >> np.uint32(10)))
            )
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[k] + w[k % 16]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return np.stack([x + y for x, y in zip(first, (a, b, c, d, e, f, g, h))], axis=1)


def fresh(n: int) -> np.ndarray:
    """The states before the first child."""
    return np.broadcast_to(START, (n, 8)).copy()


def add_child(states: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The states after one more digest, as hexadecimal text, in each."""
    return absorb(states, HEX_PAIRS[to_bytes(digests)].reshape(-1, 64).view(">u4").astype(np.uint32))


def finish(states: np.ndarray, n_children: np.ndarray) -> np.ndarray:
    """The digests of parents whose states have taken all of their children."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0] = 1 << 31
    last[:, 15] = n_children.astype(np.uint32) * np.uint32(512)
    return absorb(states, last)


def to_bytes(words: np.ndarray) -> np.ndarray:
    """Rows of 32 bytes."""
    return words.astype(">u4").view(np.uint8).reshape(-1, 32)


def from_bytes(data: bytes | np.ndarray) -> np.ndarray:
    """Rows of eight words."""
    return np.frombuffer(data, ">u4").reshape(-1, 8).astype(np.uint32)
