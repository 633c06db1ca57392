"""Stretches of a text that repeat with a period, found by seeds and extension along diagonals.

A run of period q and ``times`` * q words or more has (times - 1) * q or more words that equal
the word q places on. So it holds a seed: a k-gram that stands q places on again, for the
least such overlap of the lags looked at. Lags go by classes [2**j, 2**(j+1)), each with one
k; k-grams are named by doubling, so equal names are equal words, and a k-gram stays only while
its halves repeat in its document.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import with_columns_of

#: Bytes of text that are worked on together (a longer text is worked on by itself).
BYTES_AT_ONCE = 4 << 20
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers that are equal where both names are; 0 .. distinct - 1."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


class _Grams:
    """Names of the k-grams of many documents, for places where they may repeat in their document.

    ``words`` are numbers that differ between documents, so a k-gram over a border never repeats
    where its words do not. Names are dense arrays with -1 where a k-gram cannot repeat.
    """

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        self.powers = [self._kept(words, np.arange(len(words)))]

    def _kept(self, names: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Dense names with those that stand alone taken out."""
        dense = np.full(self.size, -1)
        if len(at):
            again = np.bincount(names)[names] > 1
            dense[at[again]] = names[again]
        return dense

    def _paired(self, first: np.ndarray, second: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of the grams made of one at a place and one ``step`` places on."""
        at = np.flatnonzero(first[: max(0, self.size - step)] >= 0)
        at = at[second[at + step] >= 0]
        return _named(first[at], second[at + step]), at

    def power(self, j: int) -> np.ndarray:
        """Names of the grams of 2**j words."""
        while len(self.powers) <= j:
            step = 1 << (len(self.powers) - 1)
            self.powers.append(self._kept(*self._paired(self.powers[-1], self.powers[-1], step)))
        return self.powers[j]

    def of_length(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of the k-grams and their places: made of the longest power of two at both ends."""
        j = k.bit_length() - 1
        power = self.power(j)
        if k == 1 << j:
            at = np.flatnonzero(power >= 0)
            return power[at], at
        return self._paired(power, power, k - (1 << j))


def runs_of(words: np.ndarray, ends: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run in documents that lie one after the other, by start
    and period. ``words`` are numbers, not shared between documents, which end at ``ends``.

    Occurrence pairs are those of a k-gram with its next occurrence in the document. No pair of a
    run is lost by that: its k is at least its period q, and two occurrences nearer than q inside
    the run would give it a smaller period. So there are no more pairs than words in a class.
    """
    if times < 3:
        raise ValueError("a run has 3 periods or more")
    longest = int(np.diff(ends, prepend=0).max(initial=0))
    grams = _Grams(words)
    # the word q places on is in the same document where their numbers say so: none is shared
    found: dict[int, list[tuple[int, int]]] = {}
    j = 0
    while longest >= max(least, times << j):
        low, high = 1 << j, (1 << (j + 1)) - 1
        # the least overlap of a run of such a period; k >= q needs no more than twice `low`
        k = min(max(least - q, (times - 1) * q) for q in range(low, min(high, max(low, least)) + 1))
        names, at = grams.of_length(k)
        if not len(at):
            if not (grams.power(j) >= 0).any():
                break
            j += 1
            continue
        order = np.lexsort((at, names))
        names, at = names[order], at[order]
        lag = at[1:] - at[:-1]
        pair = np.flatnonzero((names[1:] == names[:-1]) & (lag >= low) & (lag <= high))
        _extended(words, at[pair], lag[pair], k, found)
        j += 1
    rows = [(s, e - s + q, q) for q, own in found.items() for s, e in own if e - s + q >= max(least, times * q)]
    rows.sort(key=lambda r: (r[0], r[2]))
    out = np.array(rows, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def _extended(words: np.ndarray, at: np.ndarray, lag: np.ndarray, k: int, found: dict[int, list[tuple[int, int]]]) -> None:
    """Extend seeds along their diagonals: adds to ``found[lag]`` the stretches [start, end) of
    words that equal the word ``lag`` places on. Seeds go by place; one that lies before the
    furthest place covered on its lag belongs to the stretch found there."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    # a seed one place after another of its lag overlaps it, so only the first of a row of seeds
    # has to be looked up, and the last of it tells how far the words are known to be equal
    first = np.r_[True, (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)][: len(at)]
    last = np.r_[first[1:], True][: len(at)]
    for start, end, q in zip(at[first].tolist(), at[last].tolist(), lag[first].tolist()):
        own = found.setdefault(q, [])
        furthest = own[-1][1] if own else -1
        if start < furthest:
            continue
        end = _furthest(words, end + k, q)
        start = _nearest(words, start, q)
        own.append((start, end))


def _furthest(words: np.ndarray, at: int, lag: int) -> int:
    """The first place from ``at`` on whose word differs from the one ``lag`` places on."""
    step = 16
    while True:
        a, b = words[at : at + step], words[at + lag : at + lag + step]
        unequal = np.flatnonzero(a[: len(b)] != b)
        if len(unequal):
            return at + int(unequal[0])
        if len(b) < step:
            return at + len(b)
        at, step = at + step, step * 2


def _nearest(words: np.ndarray, at: int, lag: int) -> int:
    """The first place of the stretch before ``at`` whose words equal those ``lag`` places on."""
    step = 16
    while at:
        low = max(0, at - step)
        unequal = np.flatnonzero(words[low:at] != words[low + lag : at + lag])
        if len(unequal):
            return low + int(unequal[-1]) + 1
        at, step = low, step * 2
    return 0


def best_of(starts: list[int], lengths: list[int], periods: list[int]) -> int:
    """Place in the lists of the run with the greatest length / period, then least start, then period."""
    rough = [n / q for n, q in zip(lengths, periods)]
    top = max(rough)  # rounding keeps the order, so the greatest is among those that look greatest
    near = [i for i, x in enumerate(rough) if x == top]
    return min(near, key=lambda i: (-Fraction(lengths[i], periods[i]), starts[i], periods[i]))


def _read(texts: list[bytes | None], least: int, times: int) -> tuple[list[int], list, list[bytes]]:
    """For each text its number of words, its runs, the best one first of all, and its collapsed words."""
    words = [t.split() if t else [] for t in texts]  # bytes: white space is ASCII's
    counts = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(counts)
    numbers = np.empty(int(counts.sum()), np.int64)
    given = 0
    for own, end in zip(words, ends.tolist()):
        number: dict[bytes, int] = {}
        numbers[end - len(own) : end] = [number.setdefault(w, given + len(number)) for w in own]
        given += len(number)
    start, length, period = runs_of(numbers, ends, least, times)
    drop = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    keep = np.cumsum(drop)[:-1] == 0
    doc = np.searchsorted(ends, start, "right")
    begin, upto = np.searchsorted(doc, [np.arange(len(texts)), np.arange(1, len(texts) + 1)])
    runs, collapsed = [], []
    for i, (x, y) in enumerate(zip(begin.tolist(), upto.tolist())):
        first = int(ends[i] - counts[i])
        own = [(start[x:y] - first).tolist(), length[x:y].tolist(), period[x:y].tolist()]
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in zip(*own)])
        collapsed.append(b" ".join(compress(words[i], keep[first : int(ends[i])].tolist()) if y > x else words[i]))
    return counts.tolist(), runs, collapsed


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` and four columns: ``n_words``; ``runs``, an array of (start, length, period) by start
    and period, in word numbers from 0; ``top_run``, the one of greatest length / period (ties:
    smallest start, then period; null without runs); ``collapsed``, the words without the
    repetitions of a run after its first period, joined by one space.

    Words are runs of characters other than ASCII white space. A run is a stretch of words with
    smallest period q and ``least`` words and ``times`` * q words or more, which no neighbouring
    word extends.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows get equal
    results, null ids too: the id is not looked at. Texts of any length go through whole. An
    empty table gives an empty result. Further columns stay; a new column whose name is taken is numbered.
    """
    names = docs.columns
    flat, own = with_columns_of(docs, id=id_column, text=text_column)
    flat = flat.drop("id").withColumn("text", F.col("text").cast("string"))
    made = T.StructType([*flat.drop("text").schema.fields, T.StructField("n", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("top", RUN), T.StructField("left", T.BinaryType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        for batch in batches:
            at = 0
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                upto = max(at + 1, int(np.searchsorted(sizes, before + BYTES_AT_ONCE, "right")))
                part = batch.slice(at, upto - at)
                counts, runs, left = _read(part.column("text").cast(pa.binary()).to_pylist(), least, times)
                top = [r[best_of(*([x[f] for x in r] for f in ("start", "length", "period")))] if r else None for r in runs]
                more = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(top, run), pa.array(left, pa.binary())]
                kept = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *more], [*kept, "n", "runs", "top", "left"])
                at = upto

    taken, new = {n.lower() for n in names}, []
    for name in ("n_words", "runs", "top_run", "collapsed"):
        while name.lower() in taken:
            name += "_1"
        new.append(name)
    found = flat.mapInArrow(find, made)
    return found.select(*own, "n", "runs", "top", F.col("left").cast("string")).toDF(*names, *new)
