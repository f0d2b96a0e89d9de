"""PartEnum signatures: sets that are similar enough share at least one.

Sets fall into bands of about equal size; two sets within the similarity have sizes in one band or in neighbouring
bands. For a band, ``k`` is the largest size of a symmetric difference that the similarity allows. The domain of elements is cut
by a hash into ``first`` partitions, each into ``second`` parts. Two sets of a difference of at most ``k`` have more than
``spare`` partitions that hold at most ``enumerated`` of the difference, so in each of those they agree on some
``second - enumerated`` of its parts: each such subset of parts, with the elements a set has in it, is a signature.

A partition in which some subset of parts is empty gives signatures that say nothing. A set with at most ``spare``
such partitions leaves them out, and still shares one of the others; a set with more of them writes them all, and two
such sets share one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import ceil, log

import numpy as np

U = np.uint64
LEAST_ENUMERATED = 6  # with fewer different elements parts would often be empty
ENOUGH = 7  # elements of a whole partition, as at a similarity of 0.9; at 0.8 there are about four


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (fixed constants of a known finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass(frozen=True)
class Scheme:
    """Signatures of one band."""

    band: int
    k: int
    first: int
    second: int
    enumerated: int
    spare: int

    @property
    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.second), self.second - self.enumerated))


@dataclass(frozen=True)
class Similarity:
    """``top / bottom`` is the least Jaccard similarity of linked sets."""

    top: int
    bottom: int

    def most_different(self, largest: int) -> int:
        """Of two linked sets of at most ``largest`` elements."""
        return 2 * largest * (self.bottom - self.top) // (self.bottom + self.top)

    def band(self, n: int) -> int:
        """Bands grow by the factor that sizes of linked sets may differ by."""
        return 0 if n <= 1 else ceil(log(n) / log(self.bottom / self.top) - 1e-9)

    def largest_in(self, band: int) -> int:
        return int((self.bottom / self.top) ** band + 1e-6)

    def linked(self, shared, n, m):
        return self.bottom * shared >= self.top * (n + m - shared)


@lru_cache(maxsize=None)
def scheme_of(similarity: Similarity, band: int) -> Scheme:
    """For sets of this band and the one below."""
    largest = similarity.largest_in(band)
    k = similarity.most_different(largest)
    if k == 0:
        return Scheme(band, 0, 1, 1, 0, 0)
    if k < LEAST_ENUMERATED or largest >= ENOUGH * (k + 2):
        # Partitions that hold no difference say enough by themselves; the spare one covers an empty partition.
        return Scheme(band, k, k + 2, 1, 0, 1)
    # At most k / 2 partitions hold two different elements or more; in the others two of three parts agree. With fewer spare
    # partitions than this, many sets would have more partitions with empty parts than may be left out.
    spare = 2 + k // 12
    return Scheme(band, k, k // 2 + 1 + spare, 3, 1, spare)


def signatures(elements: np.ndarray, similarity: Similarity) -> np.ndarray:
    """64-bit signatures of a set (distinct 64-bit elements), those of its own band and of the next one."""
    if not len(elements):
        return np.zeros(0, np.uint64)
    own = similarity.band(len(elements))
    out = [_of_band(elements, scheme_of(similarity, band)) for band in (own, own + 1)]
    return np.unique(np.concatenate(out))


def _of_band(elements: np.ndarray, s: Scheme) -> np.ndarray:
    place = mixed(elements ^ U(0x9E3779B97F4A7C15 + 2 * s.band & 0xFFFFFFFFFFFFFFFF))
    cell = ((place >> U(33)) % U(s.first * s.second)).astype(np.int64)
    sums, sizes = np.zeros(s.first * s.second, np.uint64), np.bincount(cell, minlength=s.first * s.second)
    np.add.at(sums, cell, mixed(elements + U(0x632BE59BD9B4E019)))
    sums, sizes = sums.reshape(s.first, s.second), sizes.reshape(s.first, s.second)
    subsets = s.subsets
    inside = np.stack([sums[:, list(x)].sum(1, dtype=np.uint64) for x in subsets], 1)
    filled = np.stack([sizes[:, list(x)].sum(1) > 0 for x in subsets], 1)
    useless = ~filled.all(1)
    named = mixed(inside + mixed(
        np.arange(s.first * len(subsets), dtype=np.uint64).reshape(inside.shape) * U(1 << 20) + U(s.band)
    ))
    return (named[~useless] if useless.sum() <= s.spare else named).ravel()
