"""Packing of tokenised documents into fixed-length sequences by swap-based local search.

Documents are tokenised where they lie; only piece lengths and checksums move. Pieces are dealt
by hash into groups of bounded size. In each group a plain first-fit start, in the order of a hash,
is improved by local search: pieces move, or are exchanged one for one, two for one or one for
two, from an emptier to a fuller bin, each step raising the sum of squared fills, until bins
become empty. It is the search that empties them: first fit leaves more than the fewest
possible (12 of 2,231 bins for 8,000 pieces of the check table), and the search takes them away. Where it stops above the fewest, it
searches once more from a best-fit start, and the fewer bins stand. The bins that a group
cannot fill are opened again and their pieces packed together with those of other groups, level
by level, until one group is left or a level settles hardly any.

Cases: a null or empty text is the end token alone; a text longer than a sequence is cut into
full pieces and a rest; rows that repeat a ``doc_id``, or have none, are each packed; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, ceil_div, cut, partitions
from .tokens import word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces in a group, and the share from which a bin counts as full and is not opened again on the next level.
GROUP, FULL = 4_000, 0.995
#: A level that leaves a larger share of its pieces is the last.
SHRINKS = 0.9


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1) -> DataFrame:
    """The token pieces of every document, without the tokens themselves."""
    end = np.asarray([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = ids_of(text) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(task, PIECES)


def first_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, in the order given: the first bin that has room (a tree of the largest rooms finds it)."""
    leaves = 1 << max(1, (len(lengths) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    where = []
    for n in lengths.tolist():
        at = 1
        while at < leaves:
            at *= 2
            at += room[at] < n
        where.append(at - leaves)
        room[at] -= n
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return np.asarray(where, np.int64)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length: longest first, each into the fullest bin that has room."""
    where, bins = np.zeros(len(lengths), np.int64), 0
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        where[i] = b
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return where


class Search:
    """Local search on bins: each step shifts tokens from one bin to a fuller one, so that the sum of squared fills grows.

    A step moves a piece, or exchanges one piece for a smaller one, two for one, or one for two,
    between two underfull bins; pairs are tried where single pieces give no step. Bins
    are tried from the emptiest on, until none can shift anything or the fewest possible are left.
    """

    def __init__(self, lengths: np.ndarray, where: np.ndarray, capacity: int):
        self.size, self.where, self.capacity = lengths.astype(np.int64), where.copy(), capacity
        self.fill = np.bincount(where, lengths, where.max(initial=-1) + 1).astype(np.int64)
        self.members: list[list[int]] = [[] for _ in self.fill]
        for i, b in enumerate(where.tolist()):
            self.members[b].append(i)
        self.steps = {"move": 0, "one_for_one": 0, "two_for_one": 0, "one_for_two": 0}
        self.emptied = 0

    def _distinct(self, b: int) -> list[int]:
        """A bin's pieces, largest first, with two of each size at most: more of them give the same steps."""
        own = sorted(self.members[b], key=lambda i: -self.size[i])
        return [i for k, i in enumerate(own) if k < 2 or self.size[own[k - 2]] > self.size[i]]

    def _pairs(self) -> None:
        """All pairs within underfull bins, by the sum of their sizes; those whose bin has changed since are passed over."""
        first, second = [], []
        for b in np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist():
            m = np.asarray(self._distinct(b))
            x, y = np.triu_indices(len(m), 1)
            first.append(m[x])
            second.append(m[y])
        self.first, self.second = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second))
        self.sum, self.at = self.size[self.first] + self.size[self.second], self.where[self.first]
        self.fresh = np.ones(len(self.fill), bool)

    def _best(self, gives: int, sizes: np.ndarray | int, bins: np.ndarray, a: int) -> tuple[int, int]:
        """Of giving ``gives`` tokens of bin ``a`` for one of ``sizes`` in ``bins``: the largest growth of half the squared fills, and its place."""
        gain = gives - sizes
        fits = np.flatnonzero((gain > 0) & (gain <= self.room[bins]))
        if not len(fits):
            return 0, -1
        gain = gain[fits] if isinstance(gain, np.ndarray) else gain
        grown = gain * (self.fill[bins[fits]] - self.fill[a] + gain)
        k = int(grown.argmax())
        return int(grown[k]), int(fits[k])

    def step(self, a: int) -> bool:
        """A step out of bin ``a``: of the first kind that has any, the one by which the squared fills grow most."""
        self.room = np.where((self.fill >= self.fill[a]) & (self.fill > 0), self.capacity - self.fill, 0)
        self.room[a] = 0
        open_ = np.flatnonzero(self.room)
        if not len(open_):
            return False
        own = self._distinct(a)
        near = np.flatnonzero(self.room[self.where] > 0)  # pieces of bins that can take something
        sizes, bins = self.size[near], self.where[near]
        most, best = 0, None
        for i in own:
            n = int(self.size[i])
            grown, k = self._best(n, 0, open_, a)
            if grown > most:
                most, best = grown, ("move", [i], [], int(open_[k]))
            grown, k = self._best(n, sizes, bins, a)
            if grown > most:
                most, best = grown, ("one_for_one", [i], [int(near[k])], int(bins[k]))
        if best is not None:
            return self._take(a, best)
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                grown, n = self._best(int(self.size[i] + self.size[j]), sizes, bins, a)
                if grown > most:
                    most, best = grown, ("two_for_one", [i, j], [int(near[n])], int(bins[n]))
        if best is not None:
            return self._take(a, best)
        alive = np.flatnonzero(self.fresh[self.at] & (self.room[self.at] > 0))
        sums, at = self.sum[alive], self.at[alive]
        for i in own:
            grown, k = self._best(int(self.size[i]), sums, at, a)
            if grown > most:
                most, best = grown, ("one_for_two", [i], [int(self.first[alive[k]]), int(self.second[alive[k]])], int(at[k]))
        return self._take(a, best)

    def _take(self, a: int, best: tuple | None) -> bool:
        if best is None:
            return False
        kind, out, back, b = best
        gain = int(self.size[out].sum() - self.size[back].sum())
        self.members[a] = [i for i in self.members[a] if i not in out] + back
        self.members[b] = [i for i in self.members[b] if i not in back] + out
        self.where[out], self.where[back] = b, a
        self.fill[a] -= gain
        self.fill[b] += gain
        self.fresh[[a, b]] = False
        self.steps[kind] += 1
        self.emptied += self.fill[a] == 0
        return True

    def run(self) -> np.ndarray:
        """The bin of each piece when no step is left, or no fewer bins are possible."""
        fewest, left = -(-int(self.size.sum()) // self.capacity), int((self.fill > 0).sum())
        moved = True
        while moved and left > fewest:
            moved = False
            self._pairs()
            for a in np.argsort(self.fill, kind="stable").tolist():
                while 0 < self.fill[a] < self.capacity and left > fewest and self.step(a):
                    moved = True
                    left -= self.fill[a] == 0
        return self.where


def searched(lengths: np.ndarray, capacity: int) -> Search:
    """Local search from a first-fit start; if it ends above the fewest bins possible, also from a best-fit start; the fewer bins stand."""
    search = Search(lengths, first_fit(lengths, capacity), capacity)
    search.run()
    if (left := int((search.fill > 0).sum())) > -(-int(lengths.sum()) // capacity):
        second = Search(lengths, best_fit(lengths, capacity), capacity)
        second.run()
        if (second.fill > 0).sum() < left:
            return second
    return search


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's fill for each length; local search from a first-fit start."""
    where = searched(lengths, capacity).where
    order = np.argsort(where, kind="stable")
    n = lengths[order]
    begin = np.flatnonzero(np.diff(where[order], prepend=-1))
    before = np.cumsum(n) - n
    offset, total = np.zeros(len(n), np.int64), np.bincount(where, lengths).astype(np.int64)
    offset[order] = before - np.repeat(before[begin], np.diff([*begin, len(n)]))
    return where, offset, total[where]


def _packer(capacity: int, keys: list[str], level: int, full: float, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pack_order", "length", *keys], kind="stable", ignore_index=True)
        where, offset, total = pack_group(pdf["length"].to_numpy(), capacity)
        base = (level << 56) + (int(pdf["pack_group"].iloc[0]) << 24)
        return pdf.drop(columns=["pack_group", "pack_order"]).assign(sequence_id=where + base, offset=offset, settled=last | (total >= full * capacity))

    return one


def pack(rows: DataFrame, capacity: int = 4096, group: int = GROUP, full: float = FULL) -> DataFrame:
    """``rows`` (``length`` and anything else) with ``sequence_id`` and ``offset``."""
    rows = cut(rows)
    keys = [c for c in rows.columns if c != "length"]
    left, count, level, done = rows, rows.count(), 0, None
    while True:
        groups = ceil_div(count, group)

        schema = f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, sequence_id long, offset long, settled boolean"
        dealt = left.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(level), *keys), F.lit(groups))).withColumn("pack_order", F.xxhash64(F.lit("order"), *keys))
        placed = cut(dealt.repartition(min(groups, 8 * partitions(rows.sparkSession)), "pack_group").groupBy("pack_group").applyInPandas(_packer(capacity, keys, level, full, groups == 1), schema))
        settled = placed.where("settled").drop("settled")
        done = settled if done is None else done.union(settled)
        if groups == 1:
            return done
        left = placed.where("not settled")
        before, count, level = count, left.count(), level + 1
        if count > SHRINKS * before:  # pieces that do not fill bins in any group: keep the bins they have
            return done.union(left.drop("settled"))
        left = left.select(*rows.columns)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``; texts stay in ``docs``."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)
