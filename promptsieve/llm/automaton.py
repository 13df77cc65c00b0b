"""Suffix automata of many word sequences, and matching statistics of many others at once."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np


class Automaton:
    """The suffix automaton of some sequences of symbols 0 .. symbols - 1.

    A state stands for all strings with the same set of end positions; `length` is that of
    its longest, `first` the earliest end, counted through all sequences in their order.
    Built symbol by symbol, then held as arrays: small to send, and read by whole arrays.
    """

    def __init__(self, sequences: Iterable[Sequence[int]], symbols: int):
        follow: list[dict] = [{}]
        link, length, first = [-1], [0], [-1]
        at = -1
        for sequence in sequences:
            last = 0
            for c in sequence:
                at += 1
                own = follow[last].get(c)
                size = length[last] + 1
                if own is not None and length[own] == size:
                    last = own
                    continue
                if own is None:
                    new = len(link)
                    follow.append({})
                    link.append(0)
                    length.append(size)
                    first.append(at)
                    p = last
                    while p >= 0 and c not in follow[p]:
                        follow[p][c] = new
                        p = link[p]
                    last = new
                    if p < 0:
                        continue
                    own = follow[p][c]
                    if length[own] == length[p] + 1:
                        link[new] = own
                        continue
                else:  # the string is known, but only as part of longer ones
                    new, p = -1, last
                part = len(link)
                follow.append(follow[own].copy())
                link.append(link[own])
                length.append(length[p] + 1)
                first.append(first[own])
                while p >= 0 and follow[p].get(c) == own:
                    follow[p][c] = part
                    p = link[p]
                link[own] = part
                if new >= 0:
                    link[new] = part
                else:
                    last = part
        self.symbols = max(1, symbols)
        self.link, self.length = np.array(link), np.array(length)
        self.first = np.array(first)
        sizes = np.fromiter(map(len, follow), np.int64, len(follow))
        many = int(sizes.sum())
        key = np.fromiter((c for f in follow for c in f), np.int64, many)
        key += np.repeat(np.arange(len(follow)), sizes) * self.symbols
        to = np.fromiter((s for f in follow for s in f.values()), np.int64, many)
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where each state goes with its symbol, -1 for nowhere."""
        if not len(self.key):
            return np.full(len(state), -1)
        want = state * self.symbols + symbol
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where((self.key[at] == want) & (symbol >= 0), self.to[at], -1)

    def matches(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
        """For each position of `text` the state of the last `width` symbols of its sequence,
        -1 where fewer match.  Sequences are the spans [begin, end), read side by side;
        symbols below 0 match nothing."""
        found = np.full(len(text), -1)
        order = np.argsort(begin - end, kind="stable")
        begin, size = begin[order], (end - begin)[order]
        state, matched = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t, "left"))  # those longer than t
            state, matched = state[:live], matched[:live]
            symbol = text[begin[:live] + t]
            open_ = np.arange(live)
            while len(open_):
                to = self._step(state[open_], symbol[open_])
                went = open_[to >= 0]
                state[went] = to[to >= 0]
                matched[went] += 1
                open_ = open_[to < 0]
                lost = open_[state[open_] == 0]
                matched[lost] = 0
                open_ = open_[state[open_] > 0]
                state[open_] = self.link[state[open_]]
                matched[open_] = self.length[state[open_]]
            long = np.flatnonzero(matched >= width)
            while len(long):  # no more than the last `width` symbols are asked for
                above = self.link[state[long]]
                long = long[self.length[above] >= width]
                state[long] = self.link[state[long]]
                matched[long] = self.length[state[long]]
            hit = np.flatnonzero(matched >= width)
            found[begin[hit] + t] = state[hit]
        return found
