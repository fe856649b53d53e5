"""External suffix and common-prefix arrays by induced sorting with disk-backed bucket queues."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import numpy as np

#: Tuples that a queue or a pass holds in memory at once.
CHUNK = 1 << 16
NONE = int(np.iinfo(np.int32).max) - 1
#: Texts of up to so many symbols, as many as a pass holds, end the recursion and are sorted in memory.
SMALL = CHUNK
#: With fewer symbols than this for each key, buckets are taken several at once.
SPARSE = 64


class Spool:
    """An array in a file: written once from front to back, then mapped."""

    made = 0

    def __init__(self, folder: str, kind) -> None:
        Spool.made += 1
        self.path, self.kind, self.n = os.path.join(folder, f"{os.getpid()}-{Spool.made}"), np.dtype(kind), 0
        self.file = open(self.path, "wb", buffering=1 << 18)

    def add(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, self.kind).data)
        self.n += len(values)

    def read(self) -> np.ndarray:
        self.file.close()
        return np.asarray(np.memmap(self.path, self.kind, "r", shape=(self.n,))) if self.n else np.zeros(0, self.kind)

    def drop(self) -> None:
        self.file.close()
        os.unlink(self.path)


ZEROS = np.zeros(CHUNK, np.int32)
ZEROS.flags.writeable = False


def zeros(n: int) -> np.ndarray:
    """n zeros, for reading only, that take no room."""
    return ZEROS[:n] if n <= CHUNK else np.broadcast_to(np.int32(0), (n,))


class BucketQueue:
    """A priority queue of tuples (suffix, common prefix) keyed by symbol; equal keys leave in order of arrival.

    New tuples are kept as they come; every CHUNK / 4 of them are sorted into a run,
    and every 16 runs of a size into a larger one, which goes to disk. Without
    common, prefixes are not kept and leave as zeros.
    """

    def __init__(self, folder: str, keys: int, kind, common: bool = True) -> None:
        self.folder, self.keys, self.kind, self.common = folder, keys, kind, common
        self.recent: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.levels: list[list[tuple]] = []
        self.files: list[Spool] = []

    def push(self, key: np.ndarray, suffix: np.ndarray, lcp: np.ndarray | None) -> None:
        self.recent.append((key.astype(np.uint16) if self.keys <= 65536 else key, suffix, lcp if self.common else zeros(len(key))))
        self.held += len(key)
        if self.held >= CHUNK // 4:
            key, suffix = (np.concatenate([r[i] for r in self.recent]) for i in range(2))
            order = np.argsort(key, kind="stable")
            lcp = np.concatenate([r[2] for r in self.recent])[order] if self.common else zeros(len(key))
            self.recent, self.held = [], 0
            self._add(0, (np.searchsorted(key[order], np.arange(self.keys + 1)), suffix[order], lcp, None))

    def _add(self, level: int, run: tuple) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == 16:
            runs, self.levels[level] = self.levels[level], []
            sizes = np.stack([np.diff(r[0]) for r in runs])
            starts = np.concatenate([[0], np.cumsum(sizes.sum(0))])
            merged = []
            for part, kind in ((1, self.kind), (2, np.int32))[: 1 + self.common]:
                spool = Spool(self.folder, kind)
                lo = 0
                while lo < self.keys:  # as many keys at once as fit in about 16 chunks
                    hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 16 * CHUNK, "right")) - 1)
                    key = np.concatenate([np.repeat(np.arange(lo, hi), np.diff(r[0][lo : hi + 1])) for r in runs])
                    values = np.concatenate([r[part][r[0][lo] : r[0][hi]] for r in runs])
                    spool.add(values[np.argsort(key, kind="stable")])
                    lo = hi
                merged.append(spool)
            for r in runs:
                for old in r[3] or ():
                    old.drop()
                    self.files.remove(old)
            self.files += merged
            self._add(level + 1, (starts, merged[0].read(), merged[1].read() if self.common else zeros(int(starts[-1])), merged))

    def pop(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a key, in pieces; later pushes must have other keys."""
        parts = []
        for level in reversed(self.levels):
            for b, s, p, _ in level:
                lo, hi = b.item(key), b.item(key + 1)
                if lo < hi:
                    parts.append((s[lo:hi], p[lo:hi]))
        if self.recent:
            self.recent = [tuple(np.concatenate(x) for x in zip(*self.recent))]
            at = np.flatnonzero(self.recent[0][0] == key)
            parts.append((self.recent[0][1][at], self.recent[0][2][at]))
        for suffix, lcp in parts:
            for lo in range(0, len(suffix), CHUNK):
                yield np.asarray(suffix[lo : lo + CHUNK]), np.asarray(lcp[lo : lo + CHUNK])

    def within(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Keys from lo up to hi, suffixes and common prefixes of all their tuples, as they leave; None if they are more than CHUNK."""
        parts, n = [], 0
        for level in reversed(self.levels):
            for b, s, p, _ in level:
                i, j = b.item(lo), b.item(hi)
                if i < j:
                    n += j - i
                    if n > CHUNK:
                        return None
                    parts.append((np.repeat(np.arange(lo, hi), np.diff(b[lo : hi + 1])), s[i:j], p[i:j]))
        for key, s, p in self.recent:
            at = ((key >= lo) & (key < hi)).nonzero()[0]
            n += len(at)
            parts.append((key[at].astype(np.int64), s[at], p[at]))
        if n > CHUNK:
            return None
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, self.kind), ZEROS[:0]
        key, s, p = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        return key[order], s[order], p[order]

    def drop(self) -> None:
        for f in self.files:
            f.drop()


class Inducer:
    """Delivers the predecessors of suffixes, in the order of those, to the queue of their first symbols.

    The common prefix of two suffixes that follow one another in a bucket is 1 more
    than the least common prefix passed between the two that induced them.
    """

    def __init__(self, queue: BucketQueue, keys: int) -> None:
        self.queue = queue
        self.pending = np.full(keys, -1, np.int32)

    def feed(self, suffix: np.ndarray, lcp: np.ndarray | None, symbol: np.ndarray, c: int | np.ndarray, down: bool) -> None:
        """Takes suffixes of bucket c (or each one's), in order, with the symbols before them; delivers predecessors with symbols below c (down) or above."""
        # the symbol before the whole text is the sentinel, which is delivered to nobody
        at = ((symbol < c) & (symbol > 0) if down else symbol > c).nonzero()[0]
        s = symbol[at]
        new = None if lcp is None else self._prefixes(lcp, at, s)
        if len(s):
            self.queue.push(s, suffix[at] - 1, new)

    def _prefixes(self, lcp: np.ndarray, at: np.ndarray, s: np.ndarray) -> np.ndarray:
        if not len(lcp):
            return np.zeros(0, np.int32)
        if not len(at):
            np.minimum(self.pending, lcp.min(), out=self.pending)
            return np.zeros(0, np.int32)
        # least value between neighbouring deliveries, then between neighbours of one symbol
        least = np.minimum.reduceat(lcp[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
        n = len(at)
        order = np.argsort(s, kind="stable")
        sorted_s = s[order]
        first = np.concatenate([[True], sorted_s[1:] != sorted_s[:-1]])
        lo = np.empty(n, np.int64)  # the first delivery whose step counts
        lo[order] = np.where(first, 0, np.concatenate([[0], order[:-1] + 1]))
        hi = np.arange(n)
        table, width = [least], 1
        while 2 * width <= n:
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        new = np.empty(n, np.int32)
        for k, t in enumerate(table):
            m = level == k
            if m.any():
                new[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << k) + 1])
        firsts = order[first]
        new[firsts] = np.minimum(new[firsts], self.pending[s[firsts]])
        # what is passed after each symbol's last delivery
        tail = np.concatenate([least[1:], [lcp[at[-1] + 1 :].min() if at[-1] + 1 < len(lcp) else np.iinfo(np.int32).max]])
        suffix_min = np.minimum.accumulate(tail[::-1])[::-1]
        np.minimum(self.pending, lcp.min(), out=self.pending)
        lasts = order[np.concatenate([first[1:], [True]])]
        self.pending[s[lasts]] = suffix_min[lasts]
        return new + 1


Piece = tuple[np.ndarray, np.ndarray, np.ndarray]


def returning(suffix: np.ndarray, lcp: np.ndarray, symbol: np.ndarray, common: bool, c: int, gap: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Predecessors of bucket c's suffixes that are in c too, their common prefixes, and the least one passed since the last."""
    at = (symbol == c).nonzero()[0] if c else symbol[:0].astype(np.int64)
    if not common:
        return suffix[at] - 1, zeros(len(at)), gap
    if not len(at):
        return suffix[:0], lcp[:0], min(gap, int(lcp.min())) if len(lcp) else gap
    last = int(at[-1])
    new = np.minimum.reduceat(lcp[: last + 1], np.concatenate([[0], at[:-1] + 1])) + 1
    new[0] = min(int(new[0]), gap + 1)
    return suffix[at] - 1, new, int(lcp[last + 1 :].min()) if last + 1 < len(lcp) else NONE


def bucket(text: np.ndarray, pieces, common: bool, c: int) -> Iterator[Piece]:
    """All suffixes of a bucket in order, with common prefixes and the symbols before them: the popped ones, then round by round their predecessors in the same bucket."""
    todo, fresh, gap = list(pieces), True, NONE
    while todo:
        again, out = [], []
        small = sum(len(x[0]) for x in todo) <= CHUNK
        for suffix, lcp in todo:
            if not len(suffix):
                continue
            if fresh:
                lcp = lcp.copy()
                lcp[0], fresh = 0, False
            symbol = text[suffix - 1]
            q, new, gap = returning(suffix, lcp, symbol, common, c, gap)
            if len(q):
                again.append((q, new))
            if small:
                out.append((suffix, lcp, symbol))
            else:
                yield suffix, lcp, symbol
        if out:
            n, steady = sum(len(x[0]) for x in out), False
            while again and n <= CHUNK:
                if steady:  # all have returned: as many rounds at once as all go on
                    suffix, lcp = again[0]
                    rounds = np.arange(max(1, min(256, (CHUNK - n) // len(suffix))))[:, None]
                    stay = (text[np.maximum(suffix - 1 - rounds, -1)] == c).all(1)  # the last symbol ends every run
                    k = len(stay) if stay.all() else int(stay.argmin())
                    if k > 1:
                        symbol = np.full(k * len(suffix), c, text.dtype)
                        out.append(((suffix - rounds[:k]).ravel().astype(suffix.dtype), (lcp + rounds[:k]).ravel().astype(np.int32) if common else zeros(len(symbol)), symbol))
                        n += len(symbol)
                        again = [(suffix - k, lcp + np.int32(k) if common else lcp)]
                        continue
                more = []
                for suffix, lcp in again:
                    symbol = text[suffix - 1]
                    out.append((suffix, lcp, symbol))
                    n += len(suffix)
                    q, new, gap = returning(suffix, lcp, symbol, common, c, gap)
                    steady = len(again) == 1 and len(q) == len(suffix)
                    if len(q):
                        more.append((q, new))
                again = more
            yield (out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out)))
        todo = again


def run_length(text: np.ndarray, p: int) -> int:
    """How often the symbol at p is repeated from there on."""
    c, n, step = text[p], 1, 16
    while True:
        part = text[p + n : p + n + step]
        other = np.flatnonzero(part != c)
        if len(other) or len(part) < step:
            return n + (int(other[0]) if len(other) else len(part))
        n, step = n + step, min(2 * step, CHUNK)


def extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Common prefix lengths of the texts at a and b, up to limit; pieces of CHUNK pairs."""
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), CHUNK):
        live = np.arange(lo, min(lo + CHUNK, len(a)))
        j = 0
        if limit is not None:
            live = live[limit[live] > 0]
        while len(live):
            live = live[text[a[live] + j] == text[b[live] + j]]
            j += 1
            out[live] = j
            if limit is not None:
                live = live[limit[live] > j]
    return out


def in_turn(text: np.ndarray, first: tuple, then: tuple, common: bool, down: bool) -> tuple[np.ndarray, ...]:
    """Key, suffix, common prefix, symbol before and which part of the suffixes of several buckets: of each bucket first those of one part, then of the other.

    The parts hold key, suffix, common prefix and symbol before, by key, falling if down.
    """
    key, suffix, lcp, symbol = (np.concatenate(x) for x in zip(first, then))
    part = np.arange(len(key)) >= len(first[0])
    order = np.argsort(-key if down else key, kind="stable")
    key, suffix, symbol, part = key[order], suffix[order], symbol[order], part[order]
    if not common:
        return key, suffix, zeros(len(key)), symbol, part
    lcp = lcp[order]
    same = key[1:] == key[:-1]
    lcp[:1] = 0
    lcp[1:][~same] = 0
    meet = (same & (part[1:] != part[:-1])).nonzero()[0]
    # of these, one goes on with a smaller symbol than the bucket's and the other with a larger one
    lcp[meet + 1] = extend(text, suffix[meet].astype(np.int64), suffix[meet + 1].astype(np.int64))
    return key, suffix, lcp, symbol, part


def induce(text: np.ndarray, keys: int, seeds, several, folder: str, common: bool, wanted) -> None:
    """Sorts all suffixes from the ordered seeds.

    seeds(c) yields pieces (suffix, common prefix with the one before) of bucket c;
    several(lo, hi) has key, suffix and common prefix of the buckets from lo up to hi,
    or None. Where buckets are small, as many neighbours as induce nothing in one
    another are taken at once.
    wanted(c, suffixes, common prefixes with the larger neighbour, symbols before
    them, rising) gets all suffixes in descending order: of each bucket first those followed by a larger one.
    c and rising are one for all suffixes, or arrays.
    """
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    queue = BucketQueue(folder, keys, kind, common)
    inducer = Inducer(queue, keys)
    l_suffix, l_lcp, l_symbol = Spool(folder, kind), Spool(folder, np.int32), Spool(folder, text.dtype)
    starts = np.zeros(keys + 1, np.int64)

    def feed(parts: list[Piece], c: int, down: bool) -> None:
        if parts:
            suffix, lcp, symbol = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts))
            inducer.feed(suffix, lcp if common else None, symbol, c, down)
            parts.clear()

    sparse = len(text) < SPARSE * keys
    width, done = 64, 0
    for c in range(keys):
        if c < done:
            continue
        if sparse and c:
            hi = min(c + width, keys)
            popped, seeded = queue.within(c, hi), several(c, hi)
            if popped is not None and seeded is not None:
                b, g = (text[x[1] - 1] for x in (popped, seeded))
                met = [x[1][(x[1] >= x[0]) & (x[1] < hi)] for x in ((popped[0], b), (seeded[0], g))]
                done = min([hi, *(int(x.min()) for x in met if len(x))])
                width = min(2 * width, 1 << 12) if done == hi else max(8, 2 * (done - c))
                if done > c + 2:
                    n, k = np.searchsorted(popped[0], done), np.searchsorted(seeded[0], done)
                    popped, seeded = (*(x[:n] for x in popped), b[:n]), (*(x[:k] for x in seeded), g[:k])
                    starts[c:done] = l_suffix.n + np.searchsorted(popped[0], np.arange(c, done))
                    key, suffix, lcp, symbol, seed = in_turn(text, popped, seeded, common, False)
                    l_suffix.add(suffix[~seed])
                    if common:
                        l_lcp.add(lcp[~seed])
                    l_symbol.add(symbol[~seed])
                    inducer.feed(suffix, lcp if common else None, symbol, key, False)
                    continue
            else:
                width = max(8, width // 4)
            done = c
        starts[c] = l_suffix.n
        last, held = -1, []
        for piece in bucket(text, queue.pop(c), common, c):
            l_suffix.add(piece[0])
            if common:
                l_lcp.add(piece[1])
            l_symbol.add(piece[2])
            last = int(piece[0][-1])
            feed(held, c, False)
            held.append(piece)
        for k, (suffix, lcp) in enumerate(seeds(c)):
            if common and k == 0:
                lcp = lcp.copy()
                lcp[0] = min(run_length(text, last), run_length(text, int(suffix[0]))) if last >= 0 else 0
            if k or sum(len(x[0]) for x in held) + len(suffix) > CHUNK:
                feed(held, c, False)
            held.append((suffix, lcp, text[suffix - 1]))
        feed(held, c, False)
    starts[keys] = l_suffix.n
    queue.drop()
    l_s, l_p, l_b = l_suffix.read(), l_lcp.read(), l_symbol.read()
    queue = BucketQueue(folder, keys, kind, common)
    inducer = Inducer(queue, keys)
    width, done = 64, keys
    for c in reversed(range(keys)):
        if c >= done:
            continue
        if sparse and c:
            lo = max(1, c + 1 - width)
            i, j = int(starts[lo]), int(starts[c + 1])
            popped = queue.within(lo, c + 1) if j - i <= CHUNK else None
            if popped is not None:
                b, g, l_key = text[popped[1] - 1], l_b[i:j], np.repeat(np.arange(lo, c + 1), np.diff(starts[lo : c + 2]))
                met = b[(b >= lo) & (b <= popped[0])], g[(g >= lo) & (g < l_key)]
                done = max([lo - 1, *(int(x.max()) for x in met if len(x))]) + 1
                width = min(2 * width, 1 << 12) if done == lo else max(8, 2 * (c + 1 - done))
                if done < c - 1:
                    at = np.searchsorted(popped[0], done)
                    i = int(starts[done])
                    after = np.append(l_p[i + 1 : j], 0).astype(np.int32)[: j - i] if common else zeros(j - i)
                    falling = l_key[len(l_key) - (j - i) :][::-1], l_s[i:j][::-1], after[::-1], l_b[i:j][::-1]
                    key, suffix, lcp, symbol, tail = in_turn(text, (*(x[at:] for x in popped), b[at:]), falling, common, True)
                    if len(key):
                        wanted(key, suffix, lcp, symbol, ~tail)
                    inducer.feed(suffix, lcp if common else None, symbol, key, True)
                    continue
            else:
                width = max(8, width // 4)
            done = c + 1
        last, held = -1, []
        # the sentinel has no successor that could induce it
        pieces = queue.pop(c) if c else [(np.array([len(text) - 1], kind), np.zeros(1, np.int32))]
        for piece in bucket(text, pieces, common, c):
            wanted(c, *piece, True)
            last = int(piece[0][-1])
            feed(held, c, True)
            held.append(piece)
        for hi in range(starts[c + 1], starts[c], -CHUNK):
            lo = max(starts[c], hi - CHUNK)
            suffix, symbol = l_s[lo:hi][::-1], l_b[lo:hi][::-1]
            if common:
                after = l_p[lo + 1 : hi + 1][::-1].copy()
                if len(after) < len(suffix):
                    after = np.concatenate([[0], after]).astype(np.int32)
                if hi == starts[c + 1]:
                    after[0] = min(run_length(text, int(suffix[0])), run_length(text, last)) if last >= 0 else 0
            else:
                after = zeros(len(suffix))
            wanted(c, suffix, after, symbol, False)
            if sum(len(x[0]) for x in held) + len(suffix) > CHUNK:
                feed(held, c, True)
            held.append((suffix, after, symbol))
        feed(held, c, True)
    queue.drop()
    for f in (l_suffix, l_lcp, l_symbol):
        f.drop()


def direct(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes of a short text, by doubling in memory."""
    n = len(text)
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while ranks[-1].max() + 1 < n:
        r = ranks[-1]
        second = np.zeros(n, np.int64)
        second[:-step] = r[step:] + 1
        ranks.append(np.unique(r * (n + 1) + second, return_inverse=True)[1])
        step *= 2
    order = np.argsort(ranks[-1])
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in reversed(range(len(ranks))):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        # equal ranks of a step that passes the end cannot be: the sentinel is unique
        lcp[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, lcp


def suffix_array(text: np.ndarray, keys: int, folder: str, small: int | None = None) -> tuple[Spool, Spool]:
    """Suffixes in descending order, and each one's common prefix with the next smaller; text ends with its only 0.

    The starts of ascending runs after descending ones (S*) are sorted by their
    parts up to the next: by induction from any order within a symbol, then named.
    If names repeat, the names' text, in digits of the root of their number, is
    sorted by recursion. From the sorted S* all others are induced, larger ones
    first by a pass upwards, smaller ones by a pass downwards. A text of at most
    small symbols (SMALL by default) is sorted in memory.
    """
    small = SMALL if small is None else small
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    out_s, out_p = Spool(folder, kind), Spool(folder, np.int32)
    if n <= small:
        order, lcp = direct(np.asarray(text))
        out_s.add(order[::-1])
        out_p.add(lcp[::-1])
        return out_s, out_p

    runs = Spool(folder, kind)
    runs.add(np.zeros(1))
    for lo in range(1, n, CHUNK):
        part = np.asarray(text[lo - 1 : min(lo + CHUNK, n)])
        runs.add(np.flatnonzero(part[1:] != part[:-1]) + lo)
    starts = runs.read()
    star = Spool(folder, kind)
    for lo in range(1, len(starts), CHUNK):
        at = np.asarray(starts[lo - 1 : min(lo + CHUNK + 1, len(starts))])
        s = np.asarray(text[at]).astype(np.int64)
        if lo + CHUNK >= len(starts):
            s, at = np.concatenate([s, [keys]]), np.concatenate([at, [n]])
        star.add(at[1:-1][(s[1:-1] < s[:-2]) & (s[1:-1] < s[2:])])
    places = star.read()
    runs.drop()
    m = len(places)

    first = BucketQueue(folder, keys, kind, False)
    for lo in range(0, m, CHUNK):
        p = np.asarray(places[lo : lo + CHUNK])
        first.push(np.asarray(text[p]), p, None)
    sorted_star = Spool(folder, kind)

    def is_star(c: int, suffix: np.ndarray, _, symbol: np.ndarray, rising: bool) -> None:
        sorted_star.add(suffix[(symbol > c) & rising])

    induce(text, keys, first.pop, first.within, folder, False, is_star)
    first.drop()
    down = sorted_star.read()
    gaps = np.append(np.asarray(places[1:]) - np.asarray(places[:-1]), 0) + 1
    names = np.memmap(os.path.join(folder, f"{os.getpid()}-names-{Spool.made}"), np.int64, "w+", shape=(m,))
    name = -1
    for lo in range(0, m, CHUNK):
        # ascending: the end of the descending list first
        hi_d = m - lo
        lo_d = max(0, hi_d - CHUNK)
        p = np.asarray(down[lo_d : min(hi_d + 1, m)])[::-1]  # one more in front, but for the first piece
        skip = 1 if hi_d < m else 0
        k = np.searchsorted(places, p)
        a, b, ka, kb = p[:-1], p[1:], k[:-1], k[1:]
        length = np.where(gaps[ka] == gaps[kb], gaps[ka], 0)
        equal = (length > 0) & (extend(text, a, b, length) == length)
        new = np.concatenate([[] if skip else [True], ~equal]).astype(np.int64)
        named = np.cumsum(new) + name
        names[k[skip:]] = named
        name = int(named[-1])
    if name + 1 == m:
        order, shared = down, None
    else:
        base = max(2, int(np.ceil(np.sqrt(name + 1))))
        digits = 1 if name < 2048 or 2 * m > 0.9 * n else 2
        reduced = Spool(folder, np.uint16 if (name if digits == 1 else base) < 65000 else np.int64)
        for lo in range(0, m - 1, CHUNK):
            v = np.asarray(names[lo : min(lo + CHUNK, m - 1)])
            reduced.add(v if digits == 1 else np.stack([v // base + 1, v % base + 1], 1).ravel())
        reduced.add(np.zeros(1))
        sa, lcp = suffix_array(reduced.read(), name + 1 if digits == 1 else base + 1, folder, small)
        sa_r, lcp_r = sa.read(), lcp.read()
        sorted_star.drop()
        sorted_star, shared_spool = Spool(folder, kind), Spool(folder, np.int32)
        carry = np.iinfo(np.int32).max
        for lo in range(0, len(sa_r), CHUNK):
            q, p = np.asarray(sa_r[lo : lo + CHUNK]), np.asarray(lcp_r[lo : lo + CHUNK])
            keep = np.flatnonzero(q % digits == 0)
            if not len(keep):
                carry = min(carry, int(p.min()))
                continue
            # the prefix shared with the next smaller kept suffix is the least one from a kept suffix to just before the next
            least = np.minimum.reduceat(p, keep)
            if keep[0] > 0:
                carry = min(carry, int(p[: keep[0]].min()))
            if sorted_star.n:
                shared_spool.add(np.array([carry]) // digits)
            shared_spool.add(least[:-1] // digits)
            carry = int(least[-1])
            sorted_star.add(np.asarray(places[q[keep] // digits]))
        shared_spool.add(np.array([carry]) // digits)
        for f in (reduced, sa, lcp):
            f.drop()
        order, shared = sorted_star.read(), shared_spool.read()
    os.unlink(names.filename)
    del names

    # common prefixes of neighbouring S* suffixes: whole equal parts, then symbol by symbol
    exact = Spool(folder, np.int32)
    for lo in range(0, m, CHUNK):
        p = np.asarray(order[lo : min(lo + CHUNK + 1, m)]).astype(np.int64)
        count = min(CHUNK, m - lo)
        a, b = p[:count], p[1 : count + 1]
        a = a[: len(b)]
        skip = np.zeros(len(b), np.int64)
        if shared is not None:
            k = np.searchsorted(places, a)
            skip = np.asarray(places[k + np.asarray(shared[lo : lo + len(b)])]).astype(np.int64) - a
        value = skip + extend(text, a + skip, b + skip)
        exact.add(value)
        if len(b) < count:
            exact.add(np.zeros(1))
    prefix = exact.read()

    bounds = np.zeros(keys + 1, np.int64)  # S* of each symbol, from the end of the descending list
    for lo in range(0, m, CHUNK):
        bounds[1:] += np.bincount(np.asarray(text[np.asarray(order[lo : lo + CHUNK])]), minlength=keys)[:keys]
    bounds = np.cumsum(bounds)

    def seeds(c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo in range(bounds[c], bounds[c + 1], CHUNK):
            hi = min(lo + CHUNK, bounds[c + 1])
            yield np.asarray(order[m - hi : m - lo])[::-1], np.asarray(prefix[m - hi : m - lo])[::-1]

    def several(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        i, j = int(bounds[lo]), int(bounds[hi])
        if j - i > CHUNK:
            return None
        return np.repeat(np.arange(lo, hi), np.diff(bounds[lo : hi + 1])), np.asarray(order[m - j : m - i])[::-1], np.asarray(prefix[m - j : m - i])[::-1]

    held: list = [None]

    def collect(c: int, suffix: np.ndarray, lcp: np.ndarray, *_) -> None:
        # lcp[i] is shared with the next larger one, so it belongs to that one's row
        if held[0] is not None:
            out_p.add(lcp[:1])
        out_p.add(lcp[1:])
        out_s.add(suffix)
        held[0] = True

    induce(text, keys, seeds, several, folder, True, collect)
    out_p.add(np.zeros(1))
    for f in (star, sorted_star, exact):
        f.drop()
    if shared is not None:
        shared_spool.drop()
    return out_s, out_p


def scratch(folder: str, name: str) -> str:
    """An empty folder of one task attempt."""
    path = os.path.join(folder, name)
    shutil.rmtree(path, ignore_errors=True)
    os.makedirs(path)
    return path
