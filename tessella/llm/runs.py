"""Periodic runs of words: maximal stretches that repeat a block at least so many times, found by refining classes of equal factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bound_batches, fresh, tidy

#: Up to so many positions are moved one by one, if they leave different classes: less work than the fixed costs of moving all at once.
FEW = 32
#: Bytes of text whose documents are refined together, so that a round's fixed costs are shared; a longer text is taken alone.
TOGETHER = 8 << 20


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def bounds(*keys: np.ndarray) -> np.ndarray:
    """True where a group of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


class Partition:
    """Positions in classes of equal factors of one length, refined from each length to the next.

    Factors of length + 1 are equal when those of length are and the next position's are. A class that fell apart in a round divides
    the positions before its members in the next; all its parts but the largest suffice for that, so that a position is
    moved only when its class shrinks to half or less: O(n log n) in all. Every round works on all moved positions at once.

    order holds the positions by class, at their places; first and size are a class' range there. after and before are a position's neighbours in its class."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.order = np.argsort(words, kind="stable")
        new = bounds(words[self.order])
        starts, number = np.flatnonzero(new), np.cumsum(new) - 1
        self.of, self.place = np.empty(n, np.int64), np.empty(n, np.int64)
        self.of[self.order], self.place[self.order] = number, np.arange(n)
        self.classes = len(starts)
        self.first, self.size = np.zeros(2 * n + 1, np.int64), np.zeros(2 * n + 1, np.int64)
        self.first[: len(starts)], self.size[: len(starts)] = starts, np.diff(np.append(starts, n))
        self.after, self.before = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.link(self.order, new)
        self.small = self.order  # members of the classes that divide others in the next round

    def link(self, members: np.ndarray, new: np.ndarray) -> None:
        """Neighbours of members that stand by class and position; new: where a class begins."""
        same = ~new[1:]
        self.after[members] = np.append(np.where(same, members[1:], -1), -1)[: len(members)]
        self.before[members] = np.append(-1, np.where(same, members[:-1], -1))[: len(members)]

    def refine(self) -> np.ndarray:
        """Goes to the next length. Returns the positions that got another neighbour after them."""
        p = self.small[self.small > 0] - 1
        mother = self.of[p]
        wide = self.size[mother] > 1
        p, mother = p[wide], mother[wide]
        if len(p) <= FEW and len(set(mother.tolist())) == len(p):
            self.small = p
            return np.array([y for x in p.tolist() for y in self.alone(x)], np.int64)
        by = self.of[p + 1]
        sort = np.lexsort((p, by, mother))
        p, by, mother = p[sort], by[sort], mother[sort]
        # parts: the members of a class whose next positions share a class; what is left of the class is a part as well
        new = bounds(mother, by)
        start = np.flatnonzero(new)
        count, of_part = np.diff(np.append(start, len(p))), mother[start]
        head = np.flatnonzero(bounds(of_part))
        parts = np.diff(np.append(head, len(of_part)))
        rest = self.size[of_part[head]] - np.add.reduceat(count, head)
        most = np.maximum.reduceat(count, head)
        largest = np.zeros(len(count), bool)  # one part of each class, the first with the most members
        rank = np.lexsort((np.arange(len(count)), -count, of_part))
        largest[rank[head]] = True
        rest_, most_ = np.repeat(rest, parts), np.repeat(most, parts)
        stays = largest & (rest_ == 0)  # such a part keeps the class' number; if it is the only one, nothing is divided
        divides = ~stays & ~(largest & (most_ > rest_))
        label = np.where(stays, of_part, 0)
        label[~stays] = self.classes + np.arange((~stays).sum())
        moved = np.repeat(~stays, count)
        x, home, to = p[moved], mother[moved], np.repeat(label, count)[moved]
        if not len(x):
            self.small = x
            return x
        # the rest of a class divides too where a part is larger
        left = of_part[head][(rest > 0) & (most > rest)]
        changed = self.leave(x, home)
        self.regroup(x, home, to)
        self.link(x, bounds(to))
        self.classes += int((~stays).sum())
        self.small = np.concatenate([p[np.repeat(divides, count)], self.order[ranges(self.first[left], self.size[left])]])
        return np.concatenate([changed, x])

    def alone(self, x: int) -> list[int]:
        """Makes x, a member of a larger class that no other leaves, a class of its own, which is the smaller part. Returns what refine does."""
        c, a, b, at = self.of[x], self.before[x], self.after[x], self.place[x]
        last = self.first[c] + self.size[c] - 1
        y = self.order[last]
        self.order[at], self.place[y], self.order[last], self.place[x] = y, at, x, last
        self.size[c] -= 1
        self.of[x], self.first[self.classes], self.size[self.classes] = self.classes, last, 1
        self.classes += 1
        self.after[x] = self.before[x] = -1
        if b >= 0:
            self.before[b] = a
        if a < 0:
            return []
        self.after[a] = b
        return [int(a)]

    def leave(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Takes x out of the chains of their classes. Returns the positions whose neighbour after them is another one now."""
        sort = np.lexsort((x, home))
        x = x[sort]
        broken = np.append(self.after[x[:-1]] != x[1:], True)  # ends of stretches of neighbours that all leave
        last, head = x[broken], x[np.append(True, broken[:-1])]
        a, b = self.before[head], self.after[last]
        self.after[a[a >= 0]] = b[a >= 0]
        self.before[b[b >= 0]] = a[b >= 0]
        return a[a >= 0]

    def regroup(self, x: np.ndarray, home: np.ndarray, to: np.ndarray) -> None:
        """Moves x, which stand by home and new class, to the ends of their homes' ranges, and makes these ranges of their own."""
        head = np.flatnonzero(bounds(home))
        count, homes = np.diff(np.append(head, len(home))), home[head]
        slots = ranges(self.first[homes] + self.size[homes] - count, count)
        inside = self.order[slots]
        goes = np.isin(inside, x, assume_unique=True, invert=True)
        # those of x that stand outside of the slots are as many as the others inside, class by class: they change places
        holes = self.place[x]
        holes = holes[holes < np.repeat(self.first[homes] + self.size[homes] - count, count)]
        self.order[holes], self.place[inside[goes]] = inside[goes], holes
        self.order[slots], self.place[x], self.of[x] = x, slots, to
        begin = np.flatnonzero(bounds(to))
        self.first[to[begin]], self.size[to[begin]] = slots[begin], np.diff(np.append(begin, len(to)))
        self.size[homes] -= count


def runs_of(words: np.ndarray, longest: int, min_length: int, min_repeats: int) -> np.ndarray:
    """start, length, period of all runs of a sequence, by start and period. longest: no period above it is looked for.

    At length q, neighbours of a class at distance q begin a square whose root is no repetition itself; squares at
    consecutive positions are one run, so that q is its smallest period and no neighbouring word extends it."""
    part, found = Partition(words), []
    length, upto, sorted_at, gaps, late = 1, 0, None, None, {}
    while length <= longest:
        if length > upto:  # positions by distance for the lengths up to twice this one; later changes are kept apart
            upto, late = 2 * length, {}
            far = part.after - np.arange(len(words))
            near = np.flatnonzero((far >= length) & (far <= upto))
            sorted_at = near[np.argsort(far[near], kind="stable")]
            gaps = far[sorted_at]
        low, high = gaps.searchsorted(length), gaps.searchsorted(length + 1)
        at, need = late.pop(length, []), max(min_length - 2 * length + 1, (min_repeats - 2) * length + 1, 1)
        if high - low + len(at) >= need:
            at = np.array([*sorted_at[low:high].tolist(), *at], np.int64)
            at = np.unique(at[part.after[at] - at == length])
        if len(at) >= need:
            begin = np.flatnonzero(np.append(True, np.diff(at) > 1))
            squares = np.diff(np.append(begin, len(at)))
            long = squares >= need
            found.append(np.stack([at[begin][long], squares[long] + 2 * length - 1, np.full(long.sum(), length)], 1))
        changed = part.refine()
        if not len(part.small):
            break
        length += 1
        if len(changed):
            gap = part.after[changed] - changed
            soon = (gap >= length) & (gap <= upto)
            for k, x in zip(gap[soon].tolist(), changed[soon].tolist(), strict=True):
                late.setdefault(k, []).append(x)
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_by_text(texts: list[list[bytes]], min_length: int = 24, min_repeats: int = 3) -> list[np.ndarray]:
    """runs_of of each text's words. All texts are refined together, in one sequence: a word counts as another one in each text, and a mark that occurs
    once ends each text, so that no run leaves it."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.full(int((sizes + 1).sum()), -1, np.int64)
    ids[ranges(starts, sizes)] = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
    width, owner = len(known) + 1, np.repeat(np.arange(len(texts)), sizes + 1)
    runs = runs_of(ids + 1 + owner * width, int(sizes.max(initial=0)) // min_repeats, min_length, min_repeats)
    cut = np.searchsorted(runs[:, 0], np.append(starts, len(ids)))
    return [runs[a:b] - np.array([s, 0, 0]) for a, b, s in zip(cut[:-1], cut[1:], starts, strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words outside of runs and in the first period of each, joined by one space."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)] if len(runs) else words).decode("utf-8", "replace")


def with_runs(spark: SparkSession, docs: DataFrame, text: str = "text", min_length: int = 24, min_repeats: int = 3) -> tuple[DataFrame, dict[str, str]]:
    """docs with n_words, runs (structs of start, length and period in words, by start and period) and collapsed (the words that stay, joined by one space), and
    the names of these by role, changed where docs has one of them.

    A run is a stretch of words with smallest period q, of at least min_length words and min_repeats * q, that no neighbouring word extends. A word goes if a
    run holds it after its first q words. A null or empty text, or one of blanks, has no words, no runs and an empty rest. Repeated rows get equal rows. Rows don't
    move; a task holds TOGETHER bytes of texts, or one longer text, and about 100 bytes for each of their words."""
    if min_repeats < 2:
        raise ValueError("min_repeats: 2 or more")
    bound_batches(spark)
    added = ("n_words", "runs", "collapsed")
    names = dict(zip(added, fresh(docs, *added), strict=True))
    run_type = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[r], k) for r, k in zip(added, (T.LongType(), T.ArrayType(run_type, False), T.StringType()), strict=True))])
    place = docs.columns.index(text)
    arrow_runs = pa.list_(pa.field("element", pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]), False))

    def done(held: list[tuple[pa.RecordBatch, list[list[bytes]]]]) -> Iterator[pa.RecordBatch]:
        found = iter(runs_by_text([w for _, ws in held for w in ws], min_length, min_repeats))
        for b, ws in held:
            own = [next(found) for _ in ws]
            as_rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x.tolist()] for x in own]
            more = [pa.array([len(w) for w in ws], pa.int64()), pa.array(as_rows, arrow_runs), pa.array([collapsed(w, x) for w, x in zip(ws, own, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            texts = b.column(place).cast(pa.binary()).to_pylist()
            held.append((b, [(t or b"").split() for t in texts]))
            size += sum(len(t or b"") for t in texts)
            if size >= TOGETHER:
                yield from done(held)
                held, size = [], 0
        if held:
            yield from done(held)

    return docs.mapInArrow(tidy(run), schema), names
