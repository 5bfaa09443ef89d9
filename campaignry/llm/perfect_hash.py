"""A minimal perfect hash of 64-bit hashes, in levels of bits, with the keys stored by slot for verification.

At each level every hash left falls on a position of a table; those alone on theirs stay there, the others go to the next
level. The place of a hash among all that stayed is its slot, so n keys have the slots 0 to n - 1. Keys of equal
hashes never part; they take the last slots and are found by their stored keys. A hash of no key may find a slot too: only
the key stored there tells.
"""

from __future__ import annotations

import numpy as np

#: Positions of a level for each hash that reaches it, and levels at most (what is left then has equal hashes, or is searched by key).
ROOM, LEVELS = 1.5, 40


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of h and salt (xor-shift and multiply rounds)."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def positions(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(h, level + 1) % np.uint64(size)).astype(np.int64)


def build(h: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Sizes of the levels, their bits, and the slot of each hash."""
    sizes, bits, slot = [], [], np.full(len(h), -1, np.int64)
    left, taken = np.arange(len(h)), 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, int(ROOM * len(left)))
        at = positions(h[left], level, size)
        many = np.bincount(at, minlength=size)
        alone = many[at] == 1
        here = many == 1
        place = np.cumsum(here) - 1 + taken
        slot[left[alone]] = place[at[alone]]
        taken += int(here.sum())
        sizes.append(size)
        bits.append(here)
        left = left[~alone]
    slot[left] = taken + np.arange(len(left))
    return sizes, np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool)).tobytes(), slot


class Slots:
    """Lookup in one block: its levels, and the keys by slot as an Arrow array."""

    def __init__(self, sizes: list[int], bits: bytes, keys):
        self.sizes, self.keys = list(sizes), keys
        here = np.unpackbits(np.frombuffer(bits, np.uint8))[: sum(self.sizes)].astype(bool)
        self.place = np.where(here, np.cumsum(here) - 1, -1).astype(np.int32)
        self.placed = int(here.sum())
        self.rest = {k: self.placed + i for i, k in enumerate(keys[self.placed :].to_pylist())}

    def find(self, h: np.ndarray, keys) -> np.ndarray:
        """Slot of each key (an Arrow array) of hash h, -1 for one that isn't stored."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out, left, at = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            found = self.place[at + positions(h[left], level, size)]
            out[left[found >= 0]] = found[found >= 0]
            left, at = left[found < 0], at + size
        if self.rest:
            same = {i: self.rest[k] for i in np.arange(len(h)).tolist() if (k := keys[i].as_py()) in self.rest} if len(h) else {}
        else:
            same = {}
        hit = np.flatnonzero(out >= 0)
        if len(hit):
            true = pc.equal(self.keys.take(pa.array(out[hit])), keys.take(pa.array(hit))).to_numpy(zero_copy_only=False)
            out[hit[~true]] = -1
        for i, s in same.items():
            out[i] = s
        return out
