"""Tries of number sequences as double arrays, built and walked by array arithmetic.

A state ``s`` goes on by symbol ``c`` to ``base[s] + c`` if ``check`` there is ``s``. Words are numbers of an alphabet and take two
symbols of ``BITS`` bits, so that no state has more than 4,096 successors and dense states waste little room.
"""

from __future__ import annotations

import numpy as np

BITS = 12
#: States with so many successors get room of their own, the others share what is free.
DENSE = 48


def _edges(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, symbol) of every node but the root, nodes numbered level by level, and the node at which each row ends.

    ``rows`` are sorted, different, and filled up with -1.
    """
    node, last, parents, symbols, n = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), [], [], 1
    for depth in range(rows.shape[1]):
        live = np.flatnonzero(lengths > depth)
        own, symbol = node[live], rows[live, depth]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])
        parents.append(own[new])
        symbols.append(symbol[new])
        node[live] = n + np.cumsum(new) - 1
        n += int(new.sum())
        ends = live[lengths[live] == depth + 1]
        last[ends] = node[ends]
    return np.concatenate(parents), np.concatenate(symbols), last


def _bases(first: np.ndarray, many: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """The base of each state with successors (``symbols[first : first + many]``), and the slots in use."""
    bases, used = np.zeros(len(first), dtype=np.int64), np.zeros(1 << BITS, dtype=bool)
    used[0], top, rng = True, 1, np.random.default_rng(0)
    for k in np.flatnonzero(many >= DENSE):
        own = symbols[first[k] : first[k] + many[k]]
        bases[k] = top
        if top + (1 << BITS) > len(used):
            used = np.concatenate([used, np.zeros(len(used), dtype=bool)])
        used[top + own] = True
        top += int(own[-1]) + 1
    for size in np.unique(many[many < DENSE])[::-1]:
        left = np.flatnonzero(many == size)
        while len(left):
            free = np.flatnonzero(~used)
            if len(free) < 2 * size * len(left) + (1 << BITS):
                used = np.concatenate([used, np.zeros(2 * size * len(left) + (1 << BITS), dtype=bool)])
                continue
            own = symbols[first[left][:, None] + np.arange(size)]
            base = rng.choice(free, len(left), replace=False) - own[:, 0]
            slots = base[:, None] + own
            fits = (base >= 0) & (slots[:, -1] < len(used))
            fits[fits] = ~used[slots[fits]].any(axis=1)
            taken, claim = np.unique(slots[fits].reshape(-1), return_index=True)
            claims = np.bincount(claim // size, minlength=int(fits.sum()))  # slots for which a state comes first
            won = np.flatnonzero(fits)[claims == size]
            bases[left[won]] = base[won]
            used[slots[won]] = True
            left = np.delete(left, won)
    return bases, int(np.flatnonzero(used)[-1]) + 1


def symbols_of(codes: np.ndarray) -> np.ndarray:
    """Two symbols for each number; -1 twice for -1."""
    pair = np.stack([codes >> BITS, np.where(codes < 0, -1, codes & ((1 << BITS) - 1))], axis=-1)
    return pair.reshape(*codes.shape[:-1], 2 * codes.shape[-1])


def build(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, accept) of different sequences of numbers under 2 ** 24, filled up with -1; accept is the sequence's row, or -1."""
    rows, lengths = symbols_of(codes), 2 * lengths
    order = np.lexsort(rows.T[::-1])
    parent, symbol, last = _edges(rows[order], lengths[order])
    states = np.flatnonzero(np.bincount(parent))
    first = np.searchsorted(parent, states)  # nodes are numbered so that parents come in order
    many = np.searchsorted(parent, states, "right") - first
    bases, size = _bases(first, many, symbol)
    slot = np.zeros(len(parent) + 1, dtype=np.int64)
    slot[1:] = np.repeat(bases, many) + symbol
    base, check, accept = (np.full(size + 2 * (1 << BITS), fill, dtype=np.int32) for fill in (0, -1, -1))
    base[slot[states]] = bases
    check[slot[1:]] = slot[parent]
    accept[slot[last]] = order
    return base, check, accept


def walk(trie: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The rows that sequences of numbers (-1: none of the alphabet) lead to, without those that lead to none.

    All sequences go on by one symbol at a time; those without a successor are left behind.
    """
    base, check, accept = trie
    live = np.flatnonzero((codes >= 0).all(axis=1))
    symbols = symbols_of(codes[live])
    state = np.zeros(len(live), dtype=np.int64)
    for depth in range(symbols.shape[1]):
        to = base[state] + symbols[:, depth]
        there = check[to] == state
        state, symbols = to[there], symbols[there]
    found = accept[state]
    return found[found >= 0]
