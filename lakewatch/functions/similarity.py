"""SequenceMatcher's ratio of many strings at once. What it matches is a common subsequence, so bounds rule out most pairs: the
characters that both have, by one matrix product; then the longest common subsequence, of the first 28 to 52 characters and of
all, for all pairs together in machine words. Characters share SLOTS slots by their code: a bound can only grow by that, so no pair
is lost. What is left gets SequenceMatcher's own blocks, for all pairs together too; where links are asked for, only pairs that no
earlier links join."""

from __future__ import annotations

import difflib
import functools

import numpy as np

SLOTS = 64
#: Columns of the matrix product that bounds what two strings share.
COLUMNS = 160
#: From this length on SequenceMatcher leaves out characters that are frequent.
AUTOJUNK = 200
#: How many first characters of one string are looked for in the other, in this order.
STARTS = (28, 34, 40, 52)
#: Pairs that are looked at together, and pairs that are held for the last tests.
CHUNK, HELD = 1 << 15, 1 << 18


class Strings:
    """Strings as arrays: `points`, `slots` (padded with SLOTS), `size`, and how many characters each slot has."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.size = np.array([len(s) for s in strings], np.int64)
        self.points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = self.points % SLOTS
        self.slots = np.full((len(strings), int(self.size.max(initial=1)) or 1), SLOTS, np.uint8)
        self.slots[np.arange(self.slots.shape[1]) < self.size[:, None]] = points
        row = np.repeat(np.arange(len(strings)), self.size)
        counts = np.bincount(row * SLOTS + points, minlength=len(strings) * SLOTS).reshape(-1, SLOTS)
        self.counts = np.ascontiguousarray(counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint16).T)

    @functools.cached_property
    def starts(self) -> np.ndarray:
        """Of each row and slot, in one array, the places of the first 64 characters that have it."""
        return np.ascontiguousarray(self.places(np.arange(len(self.size)), 64)[:, :, 0]).reshape(-1)

    def places(self, rows: np.ndarray, first: int | None = None) -> np.ndarray:
        """Of each row and slot, the places (the `first` ones only) that have it, as bits of 64-bit words; none for the padding."""
        slots = self.slots[rows, :first]
        out = np.zeros((len(rows), SLOTS + 1, -(-slots.shape[1] // 64)), np.uint64)
        every = np.arange(len(rows))
        for i in range(slots.shape[1]):
            out[every, slots[:, i], i // 64] |= np.uint64(1 << i % 64)
        out[:, SLOTS] = 0
        return out


def least_matches(size: np.ndarray, least: float) -> np.ndarray:
    """Characters that two strings of together `size` must match for the ratio `least`."""
    return np.ceil(least * size / 2 - 1e-9).astype(np.int64)


def shared(x: Strings, a: np.ndarray, y: Strings, b: np.ndarray) -> np.ndarray:
    """Characters that the rows `a` of x and `b` of y have in common at most, for every pair of them."""
    out = np.zeros((len(a), len(b)), np.uint16 if max(x.slots.shape[1], y.slots.shape[1]) < 1 << 16 else np.uint32)
    for own, other in zip(x.counts[:, a], y.counts[:, b]):
        if own.any() and other.any():
            out += np.minimum(own[:, None], other[None, :])
    return out


def _cells(x: Strings, y: Strings) -> list[tuple[int, int]]:
    """The cells (slot, k), for strings that have a slot k times or more, that tell the strings apart best; COLUMNS at most."""
    n, every = len(x.strings) + len(y.strings), []
    for slot in range(SLOTS):
        have = np.bincount(np.concatenate([x.counts[slot], y.counts[slot]]))
        least = n - np.cumsum(have)  # least[k - 1] have the slot k times or more
        every += [(int(m) * (n - int(m)), slot, k) for k, m in enumerate(least.tolist(), 1) if m]
    return [(slot, k) for _, slot, k in sorted(every, reverse=True)[:COLUMNS]]


def _features(x: Strings, cells: list[tuple[int, int]], least: float, left: bool) -> np.ndarray:
    """Rows whose products, left with right, are at least the characters in common less those needed: a cell that both have is a
    character in common, and of the cells left out the pair has half of both's at most."""
    out = np.zeros((len(x.strings), len(cells) + 2), np.float32)
    for n, (slot, k) in enumerate(cells):
        out[:, n] = x.counts[slot] >= k
    own = (x.size - out[:, : len(cells)].sum(axis=1, dtype=np.float64)) / 2 - least * x.size / 2
    out[:, -2:] = np.stack([own, np.ones(len(own))] if left else [np.ones(len(own)), own], axis=1)
    return out


def common(x: Strings, a: np.ndarray, y: Strings, b: np.ndarray, first: int | None = None, within: int | None = None) -> np.ndarray:
    """Length of the longest common subsequence of each pair (a[k] of x, b[k] of y), or a little more; of the `first` characters of
    the one and those of the other that are `within` a number, if these are given."""
    rows, at = np.unique(a, return_inverse=True)
    places, slots = x.places(rows, first), np.ascontiguousarray(y.slots[b].T)
    words, at = places.shape[2], at * (SLOTS + 1)
    tables = [np.ascontiguousarray(places[:, :, w]).reshape(-1) for w in range(words)]
    left = [np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64) for _ in range(words)]
    cell, u, t = np.empty(len(a), np.intp), np.empty(len(a), np.uint64), np.empty(len(a), np.uint64)
    for j in range(min(int(y.size[b].max(initial=0)), within or slots.shape[0])):
        carry = None
        np.add(at, slots[j], out=cell)
        for w in range(words):
            v = left[w]
            np.take(tables[w], cell, out=u, mode="clip")
            u &= v
            np.add(v, u, out=t)
            over = t < v if w + 1 < words else None
            if carry is not None:
                t += carry
                over = None if over is None else over | (t < carry)
            carry = None if over is None else over.astype(np.uint64)
            v ^= u  # the places of v that aren't the character's
            v |= t
    return 64 * words - sum(np.bitwise_count(v).astype(np.int64) for v in left)


def longest_blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, start in a, start in b) of the longest block of each pair of rows, padded with different values; of equal ones the
    first in a, then in b, as SequenceMatcher takes them."""
    n, a, b = len(a), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    size, i, j = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    run, after = np.zeros((2, len(b) + 1, n), np.uint8)  # strings are shorter than AUTOJUNK
    for k in range(len(a)):
        np.add(run[:-1], np.uint8(1), out=after[1:])
        after[1:] *= (b == a[k]).view(np.uint8)
        run, after = after, run
        now = run.max(axis=0)
        longer = np.flatnonzero(now > size)
        if len(longer):
            end = run[:, longer].argmax(axis=0)
            size[longer], i[longer], j[longer] = now[longer], k + 1 - now[longer].astype(np.int64), end - now[longer]
    return size, i, j


def matched(points: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Characters that SequenceMatcher matches of each pair of strings (a[k], b[k]), which lie in `points` from `start` on; a pair that
    can't reach need[k] is left as soon as that is known. Its recursion, of all pairs at once: the longest block, then what lies
    before and after it."""
    got, todo = np.zeros(len(a), np.int64), np.stack([np.arange(len(a)), start[a], size[a], start[b], size[b]])
    todo = todo[:, (todo[2] > 0) & (todo[4] > 0)]
    while todo.shape[1]:
        open_ = np.bincount(todo[0], np.minimum(todo[2], todo[4]), len(a))
        todo = todo[:, (got + open_ >= need)[todo[0]]]
        todo, parts = todo[:, np.argsort(todo[2] + todo[4], kind="stable")], []
        for m in range(0, todo.shape[1], 2048):
            pair, i, n, j, k = todo[:, m : m + 2048]
            cut = lambda at, of, pad: np.where(np.arange(int(of.max())) < of[:, None], points[np.minimum(at[:, None] + np.arange(int(of.max())), len(points) - 1)], np.uint32(pad))
            length, u, v = longest_blocks(cut(i, n, 0xFFFFFFFF), cut(j, k, 0xFFFFFFFE))
            np.add.at(got, pair, length)
            parts += [np.stack([pair, i, u, j, v]), np.stack([pair, i + u + length, n - u - length, j + v + length, k - v - length])]
            parts[-2:] = [p[:, (length > 0) & (p[2] > 0) & (p[4] > 0)] for p in parts[-2:]]
        todo = np.concatenate(parts, axis=1) if parts else todo
    return got


def ratio(p: str, q: str) -> float:
    return difflib.SequenceMatcher(None, p, q).ratio()


def _starts_reach(x: Strings, p: np.ndarray, y: Strings, columns: np.ndarray, q: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs (p[k] of x, q[k] of y) may match need[k] characters by the longest common subsequence of y's first characters and
    those of x that they can meet: of the first n of y all but its unmatched ones match there, and they are moved by what x has
    unmatched at most. `columns` are y's slots, a row for each place."""
    kept = np.flatnonzero(need <= np.minimum(x.size[p], y.size[q]))
    at, b, v, done = p[kept] * (SLOTS + 1), q[kept], np.full(len(kept), 0xFFFFFFFFFFFFFFFF, np.uint64), 0
    spare, moved = y.size[b] - need[kept], int((x.size[p] - need)[kept].max(initial=0))
    cell, u, t = np.empty(len(kept), np.intp), np.empty(len(kept), np.uint64), np.empty(len(kept), np.uint64)
    for first in STARTS:
        first = min(first, len(columns), 64 - moved)  # `starts` has 64 places, and all that can be met must be among them
        if first <= done:
            break
        for j in range(done, first):
            columns[j].take(b, out=cell, mode="clip")
            cell += at
            x.starts.take(cell, out=u, mode="clip")
            u &= v
            np.add(v, u, out=t)
            v ^= u
            v |= t
        done = first
        found = np.bitwise_count(~v & np.uint64((1 << first + moved) - 1))
        on = np.flatnonzero(found + spare >= np.minimum(first, y.size[b]))
        kept, at, b, v, spare = kept[on], at[on], b[on], v[on], spare[on]
        cell, u, t = cell[: len(on)], u[: len(on)], t[: len(on)]
    return kept


class Links:
    """Which of some nodes are joined by the links told so far."""

    def __init__(self, nodes: int):
        self.root = np.arange(nodes)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the links join what was apart."""
        above, new = self.root.tolist(), []
        for k, l in zip(a.tolist(), b.tolist()):
            while above[k] != k:
                above[k] = k = above[above[k]]
            while above[l] != l:
                above[l] = l = above[above[l]]
            above[max(k, l)] = min(k, l)
            new.append(k != l)
        root = np.array(above, np.int64)
        while (root[root] != root).any():
            root = root[root]
        self.root = root
        return np.array(new, bool)


def _place(of: np.ndarray) -> np.ndarray:
    """Which of the equal values each one is: 0 for the first."""
    order, place = np.argsort(of, kind="stable"), np.empty(len(of), np.int64)
    head = np.flatnonzero(np.diff(of[order], prepend=-1))
    place[order] = np.arange(len(of)) - np.repeat(head, np.diff(head, append=len(of)))
    return place


def alike(x: Strings, y: Strings, least: float, x_rank: np.ndarray, y_rank: np.ndarray, same: bool = False, rows: int = 256, links: bool = False) -> tuple[list[int], list[int]]:
    """(i, j) of all x[i] and y[j] whose ratio, of the one with the lower rank to the other, reaches `least`; with `same`, i < j of
    one list. With `links`, only as many of these pairs as join all that they join."""
    out: tuple[list[int], list[int]] = ([], [])
    if not x.strings or not y.strings:
        return out
    need = least_matches(np.arange(int(x.size.max()) + int(y.size.max()) + 1), least)
    cells = _cells(x, y)
    left, right = _features(x, cells, least, True), np.ascontiguousarray(_features(y, cells, least, False).T)
    slack = 1e-2 + 1e-5 * len(need)  # what the product may lose of its sum
    points, size = np.concatenate([x.points, y.points]), np.concatenate([x.size, y.size])
    start = np.cumsum(size) - size
    columns = np.ascontiguousarray(y.slots[:, : STARTS[-1]].T).astype(np.intp)
    joined = Links(len(x.strings) + (0 if same else len(y.strings)))
    node = 0 if same else len(x.strings)

    def good(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which pairs reach the ratio."""
        found = np.zeros(len(p), bool)
        for m in range(0, len(p), 1 << 14):
            k = slice(m, m + (1 << 14))
            on = m + np.flatnonzero(common(x, p[k], y, q[k]) >= need[x.size[p[k]] + y.size[q[k]]])
            lower = x_rank[p[on]] < y_rank[q[on]]
            a, b = np.where(lower, p[on], len(x.strings) + q[on]), np.where(lower, len(x.strings) + q[on], p[on])
            short = (size[a] < AUTOJUNK) & (size[b] < AUTOJUNK)
            s = np.flatnonzero(short)
            both = size[a[s]] + size[b[s]]  # two empty strings are alike
            found[on[s]] = np.where(both > 0, 2.0 * matched(points, start, size, a[s], b[s], need[both]) / np.maximum(both, 1), 1.0) >= least
            for t in np.flatnonzero(~short).tolist():
                p_, q_ = x.strings[p[on[t]]], y.strings[q[on[t]]]
                found[on[t]] = (ratio(p_, q_) if lower[t] else ratio(q_, p_)) >= least
        return found

    def close(p: np.ndarray, q: np.ndarray) -> None:
        """Adds the pairs that reach the ratio. For links, the first open pairs of all that is joined are tried, then more at a time."""
        most = 1
        while len(p):
            now = np.ones(len(p), bool)
            if links:
                r, s = joined.root[p], joined.root[node + q]
                apart = r != s
                p, q, r, s = p[apart], q[apart], r[apart], s[apart]
                now = (_place(r) < most) | (_place(s) < most)
                most *= 4
            a, b = p[now], q[now]
            on = good(a, b)
            a, b = a[on], b[on]
            if links:
                on = joined.add(a, node + b)
                a, b = a[on], b[on]
            out[0].extend(a.tolist())
            out[1].extend(b.tolist())
            p, q = p[~now], q[~now]

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, len(x.strings), rows):
        for first in range(k if same else 0, len(y.strings), 1024):
            block = left[k : k + rows] @ right[:, first : first + 1024]
            i, j = np.divmod(np.flatnonzero(block >= -slack), block.shape[1])
            i, j = i + k, j + first
            on = (i < j if same else np.ones(len(i), bool)) & (joined.root[i] != joined.root[node + j] if links else True)
            i, j = i[on], j[on]
            for m in range(0, len(i), CHUNK):
                p, q = i[m : m + CHUNK], j[m : m + CHUNK]
                on = _starts_reach(x, p, y, columns, q, need[x.size[p] + y.size[q]])
                held.append((p[on], q[on]))
            if sum(len(p) for p, _ in held) >= HELD:
                close(*np.concatenate(held, axis=1))
                held = []
    if held:
        close(*np.concatenate(held, axis=1))
    return out
