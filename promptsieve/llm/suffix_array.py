"""Suffix arrays by induced sorting and permuted common prefixes, on whole arrays.

Induction goes bucket by bucket: everything a bucket induces at once is one vector step, so
the work is linear in the text with a small alphabet.
"""

from __future__ import annotations

import numpy as np

from .text import mix


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix counts as such."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32))).astype(np.int8)
    # Where neighbours are equal the type is that of the next position that differs.
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[following] > 0, True)


class _Induction:
    def __init__(self, text: np.ndarray, smaller: np.ndarray, alphabet: int):
        self.text, self.smaller, self.alphabet = text, smaller, alphabet
        self.counts = np.bincount(text, minlength=alphabet)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts

    def sort(self, leftmost: np.ndarray) -> np.ndarray:
        """All suffixes in the order that the given leftmost-smaller ones induce."""
        text, n = self.text, len(self.text)
        out = np.full(n, -1, np.int32)
        first = text[leftmost]
        group = np.argsort(first, kind="stable")
        held = np.bincount(first, minlength=self.alphabet)
        at = np.cumsum(held) - held
        leftmost = leftmost[group]
        head = self.starts.copy()

        def put(found: np.ndarray, places: np.ndarray, step: int) -> None:
            """Append to the buckets of the found suffixes, keeping their order."""
            letter = text[found]
            order = np.argsort(letter, kind="stable")
            letter, found = letter[order], found[order]
            begin = np.flatnonzero(np.append(True, letter[1:] != letter[:-1]))
            size = np.diff(np.append(begin, len(letter)))
            offset = np.arange(len(letter)) - np.repeat(begin, size)
            out[places[letter] + step * offset] = found
            places[letter[begin]] += step * size

        def induced(block: np.ndarray, small: bool) -> np.ndarray:
            before = block[block > 0] - 1
            return before[self.smaller[before] == small]

        for c in np.flatnonzero(self.counts):
            done = self.starts[c]
            while done < head[c]:
                block, done = out[done : head[c]], head[c]
                found = induced(block, False)
                if len(found):
                    put(found, head, 1)
            found = induced(leftmost[at[c] : at[c] + held[c]], False)
            if len(found):
                put(found, head, 1)
        tail = self.ends - 1
        for c in np.flatnonzero(self.counts)[::-1]:
            done = self.ends[c] - 1
            while done > tail[c]:
                block, done = out[tail[c] + 1 : done + 1][::-1], tail[c]
                found = induced(block, True)
                if len(found):
                    put(found, tail, -1)
            found = induced(out[self.starts[c] : head[c]][::-1], True)
            if len(found):
                put(found, tail, -1)
            if c == text[-1] and self.smaller[-1] and tail[c] >= self.starts[c] and out[tail[c]] < 0:
                # the last suffix has no successor to induce it; it is the smallest of all
                out[self.starts[c]] = n - 1
        return out


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of many distinct names: ranks over doubling lengths, sorting
    only what is still tied."""
    n = len(names)
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        ranked = rank[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(begin, size)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order
        some = order[tied]
        after = np.where(some + width < n, rank[np.minimum(some + width, n - 1)] + 1, 0)
        again = np.lexsort((after, rank[some]))
        order[tied] = some[again]
        key = np.zeros(n, np.int64)
        key[some] = after
        # a rank that counts the tie and what follows it
        ranked, follow = rank[order], key[order]
        new = np.append(True, (ranked[1:] != ranked[:-1]) | (follow[1:] != follow[:-1]))
        rank[order] = np.cumsum(new)
        width *= 2


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Order of all suffixes.  The last letter must be the only one of its kind and the
    smallest; letters are below `alphabet`."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    smaller = _types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    induction = _Induction(text, smaller, alphabet)
    by_substring = induction.sort(leftmost)
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    by_substring = by_substring[is_left[by_substring]]
    # Equal leftmost-smaller substrings stand side by side now; hashes tell them apart.
    stop = np.zeros(n, np.int32)
    stop[leftmost] = np.append(leftmost[1:], n - 1) + 1
    codes = mix(np.arange(1, alphabet + 1, dtype=np.uint64))
    base = pow(0x9E3779B97F4A7C15, 1, 1 << 64)
    power = np.full(n, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.append(np.zeros(1, np.uint64), np.cumsum(codes[text] * power))
    begin, end = by_substring, stop[by_substring]
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.cumprod(down)
    whole = (total[end] - total[begin]) * down[begin]
    size = end - begin
    fresh = np.append(True, (whole[1:] != whole[:-1]) | (size[1:] != size[:-1]))
    name = np.empty(n, np.int64)
    name[by_substring] = np.cumsum(fresh)
    order = _doubled(name[leftmost])
    return induction.sort(leftmost[order])


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position the longest prefix shared with the suffix before it in the order, and
    that suffix (-1 for the first).

    Only positions whose left neighbours differ are compared; a shared prefix that also
    extends to the left is one letter shorter than that of the position before.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    known = (before > 0) & (np.arange(n) > 0)
    where = np.arange(n)
    known[known] = text[where[known] - 1] == text[before[known] - 1]
    start = np.flatnonzero(~known & (before >= 0))
    word = np.zeros(n + 8, np.uint64)
    for j in range(4):  # four letters of 16 bits at a time
        word[: max(n - j, 0)] |= text[j:].astype(np.uint64) << np.uint64(16 * j)
    shared = np.zeros(n, np.int64)
    i, p, length = start, before[start], np.zeros(len(start), np.int64)
    while len(i):
        last = np.maximum(i, p) + length
        same = (word[np.minimum(i + length, n + 7)] == word[np.minimum(p + length, n + 7)]) & (last + 4 <= n)
        stop = ~same
        x = word[np.minimum(i[stop] + length[stop], n + 7)] ^ word[np.minimum(p[stop] + length[stop], n + 7)]
        room = np.maximum(n - last[stop], 0)
        more = np.full(len(x), 4, np.int64)
        for j in (3, 2, 1, 0):
            more[(x >> np.uint64(16 * j)) & np.uint64(0xFFFF) != 0] = j
        shared[i[stop]] = length[stop] + np.minimum(more, room)
        i, p, length = i[same], p[same], length[same] + 4
    # carry on where nothing new begins
    anchor = np.maximum.accumulate(np.where(known, 0, where))
    carried = np.maximum(shared[anchor] - (where - anchor), 0)
    return np.where(known, carried, shared), before


def repeated(text: np.ndarray, alphabet: int, length: int) -> np.ndarray:
    """True where the `length` letters from a position on also start elsewhere."""
    order = suffix_array(text, alphabet)
    shared, before = common_prefixes(text, order)
    long = shared >= length
    found = long.copy()
    found[before[long]] = True
    return found
