"""Byte-pair merging of many short sequences at once, on ragged numpy arrays.

All sequences lie one after the other in one array of symbols. In each round every sequence applies its own lowest-rank
pair, at its leftmost place, as a merge queue would; finished sequences leave the array. The results are those of the
sequential algorithm for every table of merges. A sequence of over LONG symbols would need very many rounds over a long
array: it is held as a linked list in arrays, and a round applies its lowest-rank pair at all places at once. In tables
where a pair's result can have a pair of a lower rank (those made from scored pieces, not those from lists of merges)
that could differ from one merge after the other; there such a sequence leaves the arrays for a heap of its pairs.
"""

from __future__ import annotations

import heapq

import numpy as np

from panelkiln.llm.textops import ranges

LONG = 400
_NONE = np.iinfo(np.int32).max


class PairTable:
    """Ranks and results of symbol pairs. Lower ranks merge first; a pair that isn't in the table never merges."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        order = np.lexsort((rank, keys))
        keys, rank, merged = keys[order], rank[order], merged[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        keys, self.rank, self.merged = keys[first], np.append(rank[first], _NONE).astype(np.int64), np.append(merged[first], -1).astype(np.int32)
        # ordered: no pair's result has a pair of a lower rank.
        size = int(max(keys.max() >> 32, (keys & 0xFFFFFFFF).max(), self.merged.max())) + 1 if len(keys) else 1
        least = np.full(size, _NONE, np.int64)
        for part in (keys >> 32, keys & 0xFFFFFFFF):
            np.minimum.at(least, part, self.rank[:-1])
        self.ordered = bool((least[np.maximum(self.merged[:-1], 0)] > self.rank[:-1]).all())
        self.known: dict[tuple[int, int], tuple[int, int]] = {}
        # A hash table of one key a slot; what finds its slot taken goes to the sorted rest.
        self.bits = max(12, int(len(keys)).bit_length() + 3)
        self.slot_key, self.slot_at = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, len(keys), np.int32)
        slots = self._slot(keys)
        _, take = np.unique(slots, return_index=True)
        self.slot_key[slots[take]], self.slot_at[slots[take]] = keys[take], take
        rest = np.ones(len(keys), bool)
        rest[take] = False
        self.rest_key, self.rest_at = keys[rest], np.flatnonzero(rest).astype(np.int32)
        self.shared = np.zeros(1 << self.bits, bool)
        self.shared[slots[rest]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Indices into rank and merged; the last one stands for pairs that never merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self._slot(keys)
        hit = self.slot_key[slots] == keys
        out = np.where(hit, self.slot_at[slots], np.int32(len(self.rank) - 1))
        if len(self.rest_key):
            other = np.flatnonzero(~hit & self.shared[slots])
            if len(other):
                at = np.minimum(np.searchsorted(self.rest_key, keys[other]), len(self.rest_key) - 1)
                good = self.rest_key[at] == keys[other]
                out[other[good]] = self.rest_at[at[good]]
        return out


def _merge_long(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """One sequence: places wait by the rank of the pair that begins there, and the lowest rank is merged at all of them."""
    n = len(symbols)
    value, after, before = symbols.astype(np.int32), np.arange(1, n + 1), np.arange(-1, n - 1)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[after[places] < n]
        own = table.rank[table.find(value[places], value[after[places]])]
        good = own != _NONE
        order = np.argsort(own[good], kind="stable")
        places, own = places[good][order], own[good][order]
        if not len(own):
            return
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for s, e in zip(heads, np.append(heads[1:], len(own)), strict=True):
            rank = int(own[s])
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(ranks, rank)
            waiting[rank].append(places[s:e])

    wait(np.arange(n - 1))
    while ranks:
        rank = heapq.heappop(ranks)
        places = np.unique(np.concatenate(waiting.pop(rank)))
        places = places[(value[places] >= 0) & (after[places] < n)]
        at = table.find(value[places], value[after[places]])
        good = table.rank[at] == rank
        places, at = places[good], at[good]
        if not len(places):
            continue
        # of places that overlap, as in a run of one symbol, every second one merges, from the left
        fresh = np.ones(len(places), bool)
        fresh[1:] = after[places[:-1]] != places[1:]
        heads = np.flatnonzero(fresh)
        taken = (np.arange(len(places)) - np.repeat(heads, np.diff(np.append(heads, len(places))))) % 2 == 0
        rest = places[~taken]
        places, at = places[taken], at[taken]
        gone = after[places]
        value[places], value[gone] = table.merged[at], -1
        after[places] = after[gone]
        inner = after[places] < n
        before[after[places[inner]]] = places[inner]
        left = before[places]
        wait(np.concatenate([places, left[left >= 0], rest[value[rest] >= 0]]))
    return value[value >= 0]


def _merge_by_heap(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """One sequence through a heap of (rank, place)."""
    if not table.known:
        keys = np.concatenate([table.slot_key[table.slot_key >= 0], table.rest_key])
        at = np.concatenate([table.slot_at[table.slot_key >= 0], table.rest_at])
        table.known.update(zip(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist(), strict=True), zip(table.rank[at].tolist(), table.merged[at].tolist(), strict=True), strict=True))
    known, n = table.known, len(symbols)
    value, after, before = symbols.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(found[0], i, a, b) for i, (a, b) in enumerate(zip(value, value[1:], strict=False)) if (found := known.get((a, b)))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if value[i] != a or j < 0 or value[j] != b:
            continue
        value[i] = known[a, b][1]
        value[j] = -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if found := known.get((value[i], value[k])):
                heapq.heappush(heap, (found[0], i, value[i], value[k]))
        if (h := before[i]) >= 0 and (found := known.get((value[h], value[i]))):
            heapq.heappush(heap, (found[0], h, value[h], value[i]))
    return np.array([v for v in value if v != -1], np.int32)


def merge_all(symbols: np.ndarray, bounds: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The merged symbols of all sequences (in their order) and their bounds."""
    symbols, lengths = symbols.astype(np.int32), np.diff(bounds)
    results: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sequence numbers, lengths, symbols
    for k in np.flatnonzero(lengths > LONG).tolist():
        done = (_merge_long if table.ordered else _merge_by_heap)(symbols[bounds[k] : bounds[k + 1]], table)
        results.append((np.array([k]), np.array([len(done)]), done))
    alive = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    own = lengths[alive]
    now = symbols[ranges(bounds[:-1][alive], own)]
    pairs = np.full(len(now), len(table.rank) - 1, np.int32)
    if len(now):
        pairs[:-1] = table.find(now[:-1], now[1:])
        pairs[np.cumsum(own) - 1] = len(table.rank) - 1
    while len(alive):
        starts = np.cumsum(own) - own
        best = np.minimum.reduceat((table.rank[pairs] << 32) | np.arange(len(now)), starts)
        more = (best >> 32) != _NONE
        if not more.all():
            over = np.repeat(~more, own)
            results.append((alive[~more], own[~more], now[over]))
            gone = np.cumsum(over)
            at = (best & 0xFFFFFFFF)[more]
            at -= gone[at]
            now, pairs, alive, own = now[~over], pairs[~over], alive[more], own[more]
            if not len(alive):
                break
            starts = np.cumsum(own) - own
        else:
            at = best & 0xFFFFFFFF
        now[at] = table.merged[pairs[at]]
        left = np.ones(len(now), bool)
        left[at + 1] = False
        last_pair = at + 2 >= starts + own  # nothing follows the merged pair
        now, pairs = now[left], pairs[left]
        own = own - 1
        at = at - np.arange(len(at))
        starts = np.cumsum(own) - own
        pairs[at[last_pair]] = len(table.rank) - 1
        right = at[~last_pair]
        pairs[right] = table.find(now[right], now[right + 1])
        back = at[at > starts] - 1
        pairs[back] = table.find(now[back], now[back + 1])
    sizes = np.zeros(len(lengths), np.int64)
    for who, size, _ in results:
        sizes[who] = size
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(out_bounds[-1], np.int32)
    for who, size, data in results:
        out[ranges(out_bounds[:-1][who], size)] = data
    return out, out_bounds
