"""Repeated passages by external suffix arrays."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Powers, checkpoint_dir, col, cut, flat, fold_case, mix, slices, span_hashes, spans
from .suffix import CHUNK, Spool, scratch, suffix_array

#: Words of the k-grams that anchor passages.
GRAM = 25
#: Distinct words of a shard that are numbered in memory; beyond it their hashes are the symbols.
VOCABULARY = 1 << 22
#: Distinct stretches of a shard that are looked out for, so that copies are sorted once.
KNOWN = 1 << 18
SPANS = "doc_id long, row long, first_doc long, remove boolean, start long, stop long"


def rolled(words: np.ndarray, offs: np.ndarray, k: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k words from each word on, and whether they are within one row."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = powers.get(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    ends = np.repeat(offs[1:], np.diff(offs))
    return mix((total[k:] - total[:n]) * down[:n]), np.arange(n) + k <= ends[:n]


def anchors(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Winnowing: of each window of least words, the first k-gram with the least hash. Equal windows have equal anchors at equal places."""
    k = min(GRAM, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, 1):
            data, offs = flat(batch.column(1))
            data = fold_case(data)
            starts, ends, woffs = spans(data, offs)
            if len(starts) < k:
                continue
            h, ok = rolled(span_hashes(data, starts, ends, powers), woffs, k, powers)
            h = np.where(ok, h, np.uint64(0xFFFFFFFFFFFFFFFF))
            width = least - k + 1
            h = np.concatenate([h, np.full(width - 1, 0xFFFFFFFFFFFFFFFF, np.uint64)])
            at = np.unique(np.lib.stride_tricks.sliding_window_view(h, width).argmin(1) + np.arange(len(h) - width + 1))
            at = at[at < len(ok)]
            at = at[ok[at]]
            row = np.searchsorted(woffs, at, "right") - 1
            key = np.asarray(batch.column(0))[row]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(key), pa.array(at - woffs[row])], names=["g", "row", "pos"])

    return run


Columns = list[np.ndarray]


def whole_groups(batches: Iterator[pa.RecordBatch], by: Callable[[Columns], np.ndarray]) -> Iterator[Columns]:
    """Columns of sorted batches, cut so that no group lies in two; by() marks the rows that begin a group, after the first."""
    held: list[Columns] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.asarray(batch.column(i)) for i in range(batch.num_columns)]
        last = [x[-1:] for x in held[-1]] if held else [x[:0] for x in now]
        begins = np.flatnonzero(by([np.concatenate(x) for x in zip(last, now)])) + (0 if held else 1)
        if len(begins):
            at = int(begins[-1])
            held.append([x[:at] for x in now])
            yield [np.concatenate(x) for x in zip(*held)]
            held = [[x[at:] for x in now]]
        else:
            held.append(now)
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors that occur at two places at least; rows come by anchor, row and place. Holds a batch, not an anchor's copies."""
    names, last, told = ["g", "row", "pos"], None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(3)]
        if last is not None:
            cols = [np.concatenate([[x], y]) for x, y in zip(last, cols)]
        g, row, pos = cols
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1])])
        g, row, pos = g[new], row[new], pos[new]
        again = g[1:] == g[:-1]
        many = np.concatenate([[False], again]) | np.concatenate([again, [False]])
        if last is not None and told:  # the row that was carried over is out already
            many[0] = False
        told = bool(many[-1]) or (told and len(g) == 1)
        last = g[-1], row[-1], pos[-1]
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (g, row, pos)], names=names)


def leaders(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each anchor with the least anchor of the stretch of overlapping contexts that it is in; rows come by row and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = lambda c: (c[1][1:] != c[1][:-1]) | (c[2][1:] - c[2][:-1] > least)
        for g, row, pos in whole_groups(batches, begins):
            first = np.flatnonzero(np.concatenate([[True], begins([g, row, pos])]))
            lead = np.repeat(np.minimum.reduceat(g, first), np.diff(np.concatenate([first, [len(g)]])))
            pairs = np.unique(np.stack([g, lead]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["g", "lead"])

    return run


def stretches(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row and shard, the word ranges that hold every window of least words with one of the shard's anchors; rows come by row, shard and place."""
    k = min(GRAM, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, row, pos in whole_groups(batches, lambda c: c[1][1:] != c[1][:-1]):
            lo, hi = np.maximum(pos - (least - k), 0), pos + least
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1]) | (lo[1:] > hi[:-1])])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(row)]]) - 1
            rows = np.flatnonzero(np.concatenate([[True], row[first][1:] != row[first][:-1]]))
            ends = np.concatenate([rows, [len(first)]])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (shard[first], lo[first], hi[last])]
            yield pa.RecordBatch.from_arrays([pa.array(row[first][rows]), *lists], names=["row", "shard", "lo", "hi"])

    return run


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each stretch, as 32-bit hashes."""
    powers = Powers()
    for batch in slices(batches, 2):
        data, offs = flat(batch.column(2))
        data = fold_case(data)
        starts, ends, woffs = spans(data, offs)
        words = (span_hashes(data, starts, ends, powers) >> np.uint64(32)).astype(np.uint32) if len(starts) else np.zeros(0, np.uint32)
        doc, row = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[list] = [[] for _ in range(5)]
        for i, (shards, los, his) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))):
            for s, lo, hi in zip(shards, los, his):
                part = words[woffs[i] + lo : min(woffs[i] + hi, woffs[i + 1])]
                for x, v in zip(out, (s, doc[i], row[i], lo, part.tobytes())):
                    x.append(v)
        types = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["shard", "doc_id", "row", "lo", "words"])


def vocabulary(words: np.ndarray) -> np.ndarray | None:
    """The distinct words in order, gathered part by part; None if they are more than VOCABULARY."""
    names, lo = np.zeros(0, words.dtype), 0
    while lo < len(words) and len(names) <= VOCABULARY:
        hi = lo + max(4 * CHUNK, len(names) // 4)
        names, lo = np.union1d(names, np.unique(words[lo:hi])), hi
    return names if len(names) <= VOCABULARY else None


def symbols(words: np.ndarray, begin: np.ndarray, folder: str) -> tuple[Spool, int, int]:
    """Text of some symbols a word, as many 1s after each piece and a 0 at the end; the number of symbols, and how many are a word.

    A word is its place in the vocabulary in two digits, or if that is too large the 32-bit hash itself in three.
    """
    names = vocabulary(words)
    base, digits = (1 << 11, 3) if names is None else (max(2, int(np.ceil(np.sqrt(len(names))))), 2)
    spool = Spool(folder, np.uint16)
    lo, n = 0, len(begin) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + CHUNK, "right")) - 1)
        v = words[begin[lo] : begin[hi]]
        v = v.astype(np.int64) if names is None else np.searchsorted(names, v)
        at = digits * (np.arange(len(v)) + np.repeat(np.arange(hi - lo), np.diff(begin[lo : hi + 1])))
        text = np.ones(digits * (len(v) + hi - lo), np.int64)
        for i in reversed(range(digits)):
            text[at + i], v = v % base + 2, v // base
        spool.add(text)
        lo = hi
    spool.add(np.zeros(1))
    return spool, base + 2, digits


def summed(values: np.ndarray, folder: str) -> np.ndarray:
    """Sums of all values before each place, and of all, in a file."""
    spool, total = Spool(folder, np.int64), 0
    spool.add(np.zeros(1))
    for lo in range(0, len(values), CHUNK):
        part = np.cumsum(values[lo : lo + CHUNK]) + total
        spool.add(part)
        total = int(part[-1])
    return spool.read()


def copies(owner: np.ndarray, n: int, place: tuple, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of n distinct pieces: how many copies, the one at the least place, and where in the last array, of all pieces by owner, they begin."""

    def blank(name: str, size: int) -> np.ndarray:
        return np.memmap(os.path.join(folder, name), np.int64, "w+", shape=(max(size, 1),))[:size]

    times, lead, by_owner, placed = blank("times", n), blank("lead", n), blank("copies", len(owner)), blank("placed", n)
    for lo in range(0, len(owner), CHUNK):
        o = np.asarray(owner[lo : lo + CHUNK])
        order = np.lexsort((*(x[lo : lo + CHUNK] for x in reversed(place)), o))
        first = np.flatnonzero(np.concatenate([[True], o[order][1:] != o[order][:-1]]))
        u, c = o[order[first]], order[first] + lo
        old = lead[u]
        d, r, p = (x[c] for x in place)
        d0, r0, p0 = (x[old] for x in place)
        better = (times[u] == 0) | (d < d0) | ((d == d0) & ((r < r0) | ((r == r0) & (p < p0))))
        lead[u[better]] = c[better]
        times[u] += np.diff(np.concatenate([first, [len(o)]]))
    begin = summed(times, folder)
    for lo in range(0, len(owner), CHUNK):
        o = np.asarray(owner[lo : lo + CHUNK])
        order = np.argsort(o, kind="stable")
        o = o[order]
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        n_each = np.diff(np.concatenate([first, [len(o)]]))
        by_owner[begin[o] + placed[o] + np.arange(len(o)) - np.repeat(first, n_each)] = order + lo
        placed[o[first]] += n_each
    return times, lead, begin, by_owner


def passages(words: np.ndarray, size: np.ndarray, owner: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, least: int, folder: str, small: int | None = None) -> Iterator[tuple]:
    """Repeated passages of at least `least` words among pieces.

    words has the distinct pieces one after another, size their words; owner tells
    which of them each piece (doc, row, at) is. Yields doc, row, first_doc, remove, start, stop arrays: runs of starts
    whose windows of least words recur, with one first document; merged() joins runs that meet.

    All arrays may be mapped files, and all that grows with them is in files of the folder: windows are
    grouped in the order of the suffix array, each group being known by its first place, then brought
    back to the order of the text by parts.
    """
    own = scratch(folder, "passages")
    try:
        yield from _passages(words, size, owner, (doc, row, at), least, own, small)
    finally:
        shutil.rmtree(own, ignore_errors=True)


def _passages(words: np.ndarray, size: np.ndarray, owner: np.ndarray, place: tuple, least: int, folder: str, small: int | None) -> Iterator[tuple]:
    doc, row, at = place
    begin = summed(size, folder)
    spool, keys, digits = symbols(words, begin, folder)
    sep = Spool(folder, np.int64)  # where each piece begins
    for lo in range(0, len(size), CHUNK):
        part = begin[lo : min(lo + CHUNK, len(size))]
        sep.add((part + np.arange(lo, lo + len(part))) * digits)
    sep = sep.read()
    suffixes, shared = suffix_array(spool.read(), keys, folder, small)
    spool.drop()
    times, lead, copy, by_owner = copies(owner, len(size), place, folder)

    def located(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Piece and word of text places, and (doc, row, start) of the first copy."""
        piece = np.searchsorted(sep, s, "right") - 1
        inside = (s - sep[piece]) // digits
        c = lead[piece]
        return piece, inside, [doc[c], row[c], at[c] + inside]

    # windows of groups of two or more, by group; and the first place of each group
    window, firsts = [Spool(folder, np.int64) for _ in range(2)], [Spool(folder, np.int64) for _ in range(3)]
    groups, carry, open_ = 0, 0, None  # the open group: windows, first place, and its only text place while it has one window
    sa, lcp = suffixes.read(), shared.read()
    for lo in range(0, len(sa), CHUNK):
        s, p = np.asarray(sa[lo : lo + CHUNK]).astype(np.int64), np.asarray(lcp[lo : lo + CHUNK])
        piece = np.searchsorted(sep, s, "right") - 1
        inside = (s - sep[piece]) // digits
        keep = np.flatnonzero((s % digits == 0) & (inside + least <= size[piece]))
        if not len(keep):
            carry = min(carry, int(p.min()))
            continue
        if keep[0]:
            carry = min(carry, int(p[: keep[0]].min()))
        to_next = np.minimum.reduceat(p, keep)
        new = np.concatenate([[carry], to_next[:-1]]) < digits * least
        carry = int(to_next[-1])
        s = s[keep]
        piece, _, first = located(s)
        n = times[piece]
        if open_:
            s, new, n = (np.concatenate([[x], y]) for x, y in zip((open_[2], True, open_[0]), (s, new, n)))
            first = [np.concatenate([[x], y]) for x, y in zip(open_[1], first)]
        number, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        total = np.add.reduceat(n, starts)
        best = np.lexsort((*reversed(first), number))[starts]
        many = total > 1
        write = many[number] & (s >= 0)
        window[0].add((groups + np.cumsum(many) - 1)[number][write])
        window[1].add(s[write])
        done = many[:-1]
        for f, x in zip(firsts, first):
            f.add(x[best[:-1]][done])
        groups += int(done.sum())
        open_ = int(total[-1]), [int(x[best[-1]]) for x in first], -1 if many[-1] else int(s[starts[-1]])
    if open_ and open_[0] > 1:
        for f, x in zip(firsts, open_[1]):
            f.add(np.array([x]))
    del sa, lcp
    for f in (suffixes, shared):
        f.drop()

    # (text place, first document, whether it is the first place) by parts of the text
    numbers, at_text, firsts = window[0].read(), window[1].read(), [f.read() for f in firsts]
    width = 8 * CHUNK
    for lo in range(0, len(numbers), 4 * CHUNK):
        g, s = numbers[lo : lo + 4 * CHUNK], at_text[lo : lo + 4 * CHUNK]
        group = [x[g] for x in firsts]
        same = np.logical_and.reduce([x == y for x, y in zip(located(s)[2], group)])
        order = np.argsort(s // width, kind="stable")
        part, rows = (s // width)[order], np.stack([s, group[0], same], 1)[order]
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for i, j in zip(bounds[:-1], bounds[1:]):
            with open(os.path.join(folder, f"part-{part[i]}"), "ab") as f:
                f.write(np.ascontiguousarray(rows[i:j]).data)
    for k in range((int(begin[-1]) + len(size)) * digits // width + 1):
        path = os.path.join(folder, f"part-{k}")
        if not os.path.exists(path):
            continue
        rows = np.fromfile(path, np.int64).reshape(-1, 3)
        os.unlink(path)
        s, first_doc, same = rows[np.argsort(rows[:, 0])].T
        piece, inside, _ = located(s)
        new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (inside[1:] != inside[:-1] + 1) | (first_doc[1:] != first_doc[:-1]) | (same[1:] != same[:-1])])
        lo = np.flatnonzero(new)
        hi = np.concatenate([lo[1:], [len(s)]]) - 1
        piece, start, stop, first_doc, same = piece[lo], inside[lo], inside[hi] + least, first_doc[lo], same[lo] > 0
        ends = np.cumsum(times[piece])
        for i in range(0, int(ends[-1]), CHUNK):  # back from distinct pieces to all
            j = np.arange(i, min(i + CHUNK, int(ends[-1])))
            run = np.searchsorted(ends, j, "right")
            u = piece[run]
            c = by_owner[copy[u] + j - (ends[run] - times[u])]
            yield doc[c], row[c], first_doc[run], ~(same[run] & (c == lead[u])), at[c] + start[run], at[c] + stop[run]


def sorter(least: int, folder: str, small: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Builds each shard's suffix array in files of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = scratch(folder, f"suffix-{TaskContext.get().taskAttemptId()}")
        names = [x.split()[0] for x in SPANS.split(", ")]
        try:
            held: dict = {}

            def finish() -> Iterator[pa.RecordBatch]:
                for cols in passages(*(f.read() for f in held["files"].values()), least, own, small):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)
                for f in held["files"].values():
                    f.drop()
                held.clear()

            for batch in batches:
                shard = np.asarray(batch.column(0))
                for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]))):
                    if lo == hi:
                        continue
                    if held and held["shard"] != shard[lo]:
                        yield from finish()
                    if not held:
                        files = {k: Spool(own, np.uint32 if k == "words" else np.int64) for k in ("words", "size", "owner", "doc", "row", "at")}
                        held.update(shard=shard[lo], files=files, known={}, last=None)
                    part = batch.slice(int(lo), int(hi - lo))
                    # pieces come by row and place: those of rows that are wholly repeated follow one another
                    row, at = np.asarray(part.column(2)), np.asarray(part.column(3))
                    fresh = np.concatenate([[held["last"] != (row[0], at[0])], (row[1:] != row[:-1]) | (at[1:] != at[:-1])])
                    held["last"] = row[-1], at[-1]
                    part = part.filter(pa.array(fresh))
                    files, known, size, owner = held["files"], held["known"], [], []
                    for b in part.column(4):
                        raw = b.as_buffer()
                        key = hashlib.blake2b(raw, digest_size=16).digest()
                        which = known.get(key)
                        if which is None:
                            which = files["size"].n + len(size)
                            size.append(raw.size // 4)
                            files["words"].add(np.frombuffer(raw, np.uint32))
                            if len(known) < KNOWN:  # a copy of an unknown piece is sorted like any other
                                known[key] = which
                        owner.append(which)
                    for k, x in (("size", size), ("owner", owner), ("doc", part.column(1)), ("row", part.column(2)), ("at", part.column(3))):
                        files[k].add(np.asarray(x, np.int64))
            if held:
                yield from finish()
        finally:
            shutil.rmtree(own, ignore_errors=True)

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins overlapping spans of the same row, first document and kind; rows come by these and start."""

    def changes(c: Columns) -> np.ndarray:
        return np.logical_or.reduce([x[1:] != x[:-1] for x in c[:4]])

    for doc, row, first_doc, remove, start, stop in whole_groups(batches, lambda c: (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])):
        block = np.concatenate([[True], changes([doc, row, first_doc, remove])])
        number = np.cumsum(block)
        reach = np.maximum.accumulate(stop + number * (1 << 40)) - number * (1 << 40)  # furthest end so far in the block
        new = block | np.concatenate([[True], start[1:] > reach[:-1]])
        lo = np.flatnonzero(new)
        hi = np.concatenate([lo[1:], [len(doc)]]) - 1
        cols = doc[lo], row[lo], first_doc[lo], remove[lo], start[lo], reach[hi]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[x.split()[0] for x in SPANS.split(", ")])


def shared_folder(spark: SparkSession, folder: str | None) -> str:
    """A folder that every executor can open as a path: the given one, or the checkpoint folder if it is of that kind."""
    path = folder or checkpoint_dir(spark)
    path = path.removeprefix("file:")
    while path.startswith("//"):
        path = path[1:]
    if "://" in path or not path.startswith("/"):
        raise ValueError("spark.checkpoint.dir is no mounted path; give a mounted shared folder for the sorting files")
    return os.path.join(path, "driftspark-suffix")


def repeated_passages(docs: DataFrame, least: int = 50, shard_words: int = 1 << 21, broadcast_rows: int = 2_000_000, folder: str | None = None, most_tasks: int = 20_000, small: int | None = None, anchored: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Passages of at least `least` words that occur more than once: one row a document and passage.

    Columns: doc_id; start, stop (words from, and up to but not with, counted from
    0); n_words; first_doc, the least id with the passage's windows; remove, false
    for the very first occurrence and true for all later ones (also within one
    document). Words are runs of bytes above 32, with ASCII capitals in lower case.

    A passage of `least` words holds at least one winnowing anchor, and its copies
    hold the same one: so text whose anchors occur nowhere else is left aside
    without loss. The stretches around repeated anchors go to shards such that all
    occurrences of an anchor meet, anchors of one stretch together if possible. A
    shard's distinct stretches become a text in files of the shared folder, and its suffix array
    with common prefixes is built there by external induced sorting (suffix.py).
    Stretches, symbols, windows and their groups are in files too, so a shard may
    be much larger than memory. Neighbouring suffixes that share `least` words are a
    repeat. Shards have about shard_words words; an anchor's copies are never
    divided. Beyond most_tasks shards a task sorts several, one after another. What
    comes before and after the shards is sorted by Spark and passes in batches; at
    most a document's anchors or spans are held at once. Without anchored, whole
    texts go to one shard instead, with the same result. small is suffix_array's.

    Word hashes of 32 bits tell words apart (64 for anchors). The list of
    stretches is broadcast while there are at most broadcast_rows (counted first).

    Null texts, texts of fewer than `least` words and rows without an id are in no
    passage; ids are whole numbers. Wholly repeated rows count once; rows of one id with different texts
    count each, with rows of their own. Ties of first occurrences: least id, then
    text hash, then place. Extra columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = shared_folder(spark, folder)
    rows = docs.where(col(text).isNotNull() & col(doc_id).isNotNull()).select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(doc_id), col(text)).alias("row"), col(text).alias("text"))
    triples = "g long, row long, pos long"
    if anchored:
        found = rows.select("row", "text").mapInArrow(anchors(least), triples)
        found = cut(found.repartition(parts, "g").sortWithinPartitions("g", "row", "pos").mapInArrow(repeated, triples))
        shards = max(1, -(-found.count() * 14 // shard_words))
        leads = found.repartition(parts, "row").sortWithinPartitions("row", "pos").mapInArrow(leaders(least), "g long, lead long").groupBy("g").agg(F.min("lead").alias("lead"))
        placed = found.join(leads, "g").select(F.pmod(F.xxhash64("lead"), F.lit(shards)).alias("shard"), "row", "pos")
        ranges = placed.repartition(parts, "row").sortWithinPartitions("row", "shard", "pos").mapInArrow(stretches(least), "row long, shard array<long>, lo array<long>, hi array<long>")
        ranges = cut(ranges)
        if ranges.count() <= broadcast_rows:
            ranges = F.broadcast(ranges)
        held = rows.join(ranges, "row").select("doc_id", "row", "text", "shard", "lo", "hi")
    else:
        shards, one = 1, lambda v: F.array(F.lit(v).cast("long"))
        held = rows.select("doc_id", "row", "text", one(0).alias("shard"), one(0).alias("lo"), one(1 << 40).alias("hi"))
    texts = held.mapInArrow(pieces, "shard long, doc_id long, row long, lo long, words binary")
    tasks = min(shards, most_tasks)
    ordered = texts.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "row", "lo")
    repeats = ordered.mapInArrow(sorter(least, own, small), SPANS)
    spans_ = repeats.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "row", "first_doc", "remove", "start").mapInArrow(merged, SPANS)
    return spans_.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "first_doc", "remove")
