"""BagMinHash: signatures whose registers agree with the probability of the weighted Jaccard similarity.

Each word owns, for each register, a Poisson process on (0, time) x (0, weight]. The register of a
record is the first arrival among the points that lie below the weights of its words. Weights are
rounded down to a grid; the process on the whole grid is split in two, the lowest step apart from the rest, and the rest
again, and only the parts on the way to a word's weight are ever generated, which are few, as most words occur once or twice. By the lack of memory of the exponential law, the
part without the first arrival has its own first arrival an exponential time later.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from docsieve.llm.text import mixed

#: Weights that signatures tell apart, up to the last; each is at most half as much again as the one before.
GRID = (1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0)


@dataclass(frozen=True)
class BagMinHash:
    """``registers`` first arrivals per record; ``grid`` = (1.0,) makes every word count once."""

    registers: int
    grid: tuple[float, ...] = (1.0,)
    seed: int = 20_011
    block: int = field(default=32, repr=False)

    def level(self, weights: np.ndarray) -> np.ndarray:
        """Number of grid steps at or below each weight."""
        return np.searchsorted(np.asarray(self.grid), weights, side="right")

    def _random(self, words: np.ndarray, registers: np.ndarray, node: int, salt: int) -> np.ndarray:
        """24 random bits for each word and register at a node of the split, as numbers inside (0, 1)."""
        key = mixed(registers + np.uint64(self.seed * 1_000_003 + node * 2 + salt)).astype(np.uint32)
        out = np.empty((len(words), len(registers)), np.float32)
        for begin in range(0, len(words), 4_096):  # blocks that stay in the cache
            x = words[begin : begin + 4_096, None] ^ key[None, :]
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                x ^= x >> np.uint32(shift)
                x *= np.uint32(factor)
            x ^= x >> np.uint32(16)
            x >>= np.uint32(8)
            part = out[begin : begin + 4_096]
            np.copyto(part, x, casting="unsafe")
            part += np.float32(0.5)
            part *= np.float32(2.0**-24)
        return out

    def _waits(self, words: np.ndarray, registers: np.ndarray, node: int, salt: int) -> np.ndarray:
        """Waiting times of rate 1."""
        waits = np.log(self._random(words, registers, node, salt))
        return np.negative(waits, out=waits)

    def _arrivals(self, words: np.ndarray, levels: np.ndarray, registers: np.ndarray) -> np.ndarray:
        edges = np.concatenate([[0.0], self.grid])
        best = np.full((len(words), len(registers)), np.inf, np.float32)
        stack = [(0, len(self.grid), np.arange(len(words)), None)]
        while stack:
            low, high, rows, first = stack.pop()
            if not len(rows):
                continue
            node = low * 1_000 + high
            if first is None:
                first = self._waits(words[rows], registers, node, 0) / np.float32(edges[high] - edges[low])
            whole = levels[rows] >= high
            best[rows[whole]] = np.minimum(best[rows[whole]], first[whole])
            rows, first = rows[~whole], first[~whole]
            if not len(rows) or high - low == 1:
                continue
            middle = low + 1
            rate_low, rate_high = edges[middle] - edges[low], edges[high] - edges[middle]
            later, place = self._waits(words[rows], registers, node, 1), self._random(words[rows], registers, node + 1_000_000, 0)
            in_low = place < rate_low / (rate_low + rate_high)
            first_low = np.where(in_low, first, first + later / np.float32(rate_low))
            first_high = np.where(in_low, first + later / np.float32(rate_high), first)
            up = levels[rows] > middle
            best[rows[up]] = np.minimum(best[rows[up]], first_low[up])
            stack.append((low, middle, rows[~up], first_low[~up]))
            stack.append((middle, high, rows[up], first_high[up]))
        return best

    def signatures(self, words: np.ndarray, weights: np.ndarray | None, starts: np.ndarray) -> np.ndarray:
        """One row of ``registers`` unsigned 32-bit values per record.

        ``words`` are 32-bit word hashes of all records one after another, ``starts`` where each
        record begins; every record has at least one word of weight >= grid[0].
        """
        levels = np.ones(len(words), np.int64) if weights is None else self.level(weights)
        tagged = words.astype(np.uint64) | levels.astype(np.uint64) << np.uint64(32)
        _, first, where = np.unique(tagged, return_index=True, return_inverse=True)
        own_words, own_levels = words[first], levels[first]
        out = np.empty((len(starts), self.registers), np.float32)
        for begin in range(0, self.registers, self.block):
            registers = np.arange(begin, min(begin + self.block, self.registers), dtype=np.uint64)
            arrivals = self._arrivals(own_words, own_levels, registers * np.uint64(0xA24BAED4963EE407))
            step = max(1, 2_000_000 // self.block)
            at = 0
            while at < len(starts):  # a few records at a time, so that the gathered rows stay in the cache
                end = max(at + 1, int(np.searchsorted(starts, starts[at] + step)))
                last = starts[end] if end < len(starts) else len(words)
                gathered = arrivals[where[starts[at] : last]]
                out[at:end, begin : begin + len(registers)] = np.minimum.reduceat(gathered, starts[at:end] - starts[at], axis=0)
                at = end
        return out.view(np.uint32)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band of ``rows`` registers; the band's number is part of the key."""
    keys = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), bands)).copy()
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    turns = mixed(np.arange(1, rows + 1, dtype=np.uint64))
    for r in range(rows):
        keys = mixed(keys ^ (parts[:, :, r] + turns[r]))
    return keys.view(np.int64)


def bit_sketch(signatures: np.ndarray, bits: int) -> np.ndarray:
    """One bit of each of the first ``bits`` registers, as 64-bit words: records of similarity J differ in (1-J)/2 of the bits."""
    ones = (mixed(signatures[:, :bits].astype(np.uint64) + np.uint64(77)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view(np.int64)
