"""Periodic run detection (11): recursive frequency splitting, then a lag scan.

A run is a stretch of consecutive words with smallest period q that no word next
to it extends, at least ``min_length`` words and three periods long.

1. Frequency splitting. Each word of a run stands in it once a period, so three
   times at least. A word found less often within its segment joins no run and
   splits the segment; pieces shorter than a run go. That makes further words rare
   in their pieces, so pieces that were split are counted again until no piece
   changes (or for ``ROUNDS`` rounds: the scan is exact on whatever survives, the
   splitting only spares it work).
2. Lag scan over the surviving words of a whole slice of texts, one word that
   equals no other between segments. Short lags (below ``SHORT``) are compared
   word by word: stretches of equal words at lag q are the runs. For a longer lag
   a run holds two equal neighbouring blocks of q words that begin at multiples of
   q, so hashes of such blocks are compared, m/q of them for a lag, and only hits
   are carried on to their full length. That is m log m steps for m words, in
   some 2 sqrt(m) array operations, so long texts are no exception.
3. Lags that are multiples of a run's period hit as well. Lags are taken in ranges
   [Q, 2Q): no lag there is a multiple of another, and hits inside a run already
   found are left out before they are carried on, so each run is walked once.

One pass over the texts without a shuffle. A slice is about a megabyte of text, or
one longer text; arrays of some 60 bytes a word are held at a time.

Defined cases: a null or empty text has no words, no runs and an empty collapsed
text; repeated rows and ids give a row each; other columns are never read; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, column, over_texts, span_hashes, string_bytes, word_spans

#: Least words of a run, and least periods.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: Lags below this are compared word by word.
SHORT = 32
#: Rounds of splitting at most.
ROUNDS = 64
_BASE = np.uint64(0x9FB21C651E98DF25)


# ------------------------------------------------------- frequency splitting


def surviving_segments(word: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of ``word`` that may hold runs, in order."""
    n = len(word)
    cuts = np.flatnonzero(doc[1:] != doc[:-1]) + 1 if n else np.zeros(0, np.int64)
    start, end = np.concatenate([[0], cuts]).astype(np.int64), np.concatenate([cuts, [n]]).astype(np.int64)
    stable: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        long = end - start >= min_length
        start, end = start[long], end[long]
        if not len(start):
            break
        at, segment = _positions(start, end)
        _, kind, count = np.unique(segment.astype(np.uint64) * np.uint64(n) + word[at].astype(np.uint64), return_inverse=True, return_counts=True)
        stays = count[kind] >= MIN_PERIODS
        whole = np.bincount(segment, weights=~stays, minlength=len(start)) == 0
        stable.append((start[whole], end[whole]))
        alive = stays & ~whole[segment]
        at, segment = at[alive], segment[alive]
        if not len(at):
            break
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])
        first = np.flatnonzero(new)
        start, end = at[first], at[np.append(first[1:], len(at)) - 1] + 1
    else:
        stable.append((start, end))
    if not stable:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = (np.concatenate(x) for x in zip(*stable))
    long = end - start >= min_length
    order = np.argsort(start[long])
    return start[long][order], end[long][order]


def _positions(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the stretches, in order, and the number of each one's stretch."""
    size = end - start
    before = np.cumsum(size) - size
    segment = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) + np.repeat(start - before, size), segment


# ------------------------------------------------------------------ lag scan


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of true values of at least ``least``."""
    edge = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def _reach(w: np.ndarray, q: int, at: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step``, equal those q further."""
    size, done = 64, 0
    last = len(w) - q if step > 0 else -1
    while True:
        room = min(size, (last - at) * step)
        if room <= 0:
            return done
        here = w[at : at + room] if step > 0 else w[at - room + 1 : at + 1][::-1]
        there = w[at + q : at + q + room] if step > 0 else w[at + q - room + 1 : at + q + 1][::-1]
        differs = np.flatnonzero(here != there)
        if len(differs):
            return done + int(differs[0])
        done, at, size = done + room, at + room * step, size * 2


def _block_hits(sums: np.ndarray, powers: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, position) where the block of lag words from a multiple of the lag
    seems to equal the next one, for the lags low <= q < high."""
    m = len(sums) - 1
    lags, places = [], []

    def equal(q, at):
        mid = sums[at + q]
        return (mid - sums[at]) * powers[q] == sums[at + 2 * q] - mid

    if low * low <= m:  # few lags with many blocks
        for q in range(low, high):
            at = np.arange(0, m - 2 * q + 1, q)
            hit = at[equal(q, at)]
            lags.append(np.full(len(hit), q))
            places.append(hit)
    else:  # many lags with few blocks
        q = np.arange(low, high)
        for k in range(m // low - 1):
            q = q[(k + 2) * q <= m]
            hit = q[equal(q, k * q)]
            lags.append(hit)
            places.append(k * hit)
    none = [np.zeros(0, np.int64)]
    lag, place = np.concatenate(lags or none), np.concatenate(places or none)
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def lag_scan(w: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """All (start, end, period) of the runs of ``w``; none is longer than ``longest``."""
    found: dict[tuple[int, int], int] = {}  # the first lag of a stretch is its smallest period
    top = longest // MIN_PERIODS
    for q in range(1, min(top, SHORT - 1) + 1):
        start, end = _stretches(w[:-q] == w[q:], max(min_length, MIN_PERIODS * q) - q)
        for a, b in zip(start.tolist(), (end + q).tolist()):
            found.setdefault((a, b), q)
    if top >= SHORT:
        m = len(w)
        with np.errstate(over="ignore"):
            powers = np.full(m + 1, _BASE)
            powers[0] = 1
            np.cumprod(powers, out=powers)
            # the hash of w[a:b] is sum of w[i] * BASE^i over it, so a block's is the one before it times BASE^q
            sums = np.zeros(m + 1, np.uint64)
            np.cumsum(w.astype(np.uint64) * powers[:m], out=sums[1:])
        low = SHORT
        while low <= top:
            high = min(2 * low, top + 1)
            lag, place = _block_hits(sums, powers, low, high)
            if len(lag):
                _carry_on(w, lag, place, low, min_length, found)
            low *= 2
    return [(a, b, q) for (a, b), q in found.items()]


def _carry_on(w, lag, place, low: int, min_length: int, found: dict[tuple[int, int], int]) -> None:
    """Takes the hits of one range of lags to the runs that they lie in."""
    # two runs with periods below ``low`` never share 2 * low words, so a position has one run that reaches so far
    reach = np.zeros(len(w) + 1, np.int64)
    for a, b in found:
        if b - a >= 2 * low:
            reach[a : b - 2 * low + 1] = b
    left = reach[place] < place + 2 * lag
    done: tuple[int, int, int] = (0, 0, 0)  # lag, start and end of the last stretch
    for q, at in zip(lag[left].tolist(), place[left].tolist()):
        if q == done[0] and done[1] <= at and at + 2 * q <= done[2]:
            continue
        if not np.array_equal(w[at : at + q], w[at + q : at + 2 * q]):
            continue
        a = at - _reach(w, q, at - 1, -1)
        b = at + q + _reach(w, q, at, 1)
        done = (q, a, b)
        if b - a >= max(min_length, MIN_PERIODS * q):
            found.setdefault((a, b), q)


def runs_of(word: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and then period; positions count
    through ``word`` (numbers of words, of texts ``doc`` in order)."""
    start, end = surviving_segments(word, doc, min_length)
    if not len(start):
        return np.zeros((0, 3), np.int64)
    at, segment = _positions(start, end)
    n, k = len(word), len(start)
    # the surviving words, and a word of its own behind each segment
    w = np.empty(len(at) + k, np.int64)
    new = np.arange(len(at)) + segment
    w[new] = word[at]
    w[np.append(np.flatnonzero(np.diff(segment)) + np.arange(k - 1) + 1, len(w) - 1)] = n + np.arange(k)
    place = np.zeros(len(w), np.int64)
    place[new] = at
    found = lag_scan(w, int((end - start).max()), min_length)
    rows = np.array([(place[a], place[b - 1] + 1, q) for a, b, q in found], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


# -------------------------------------------------------------------- texts


def _collapse(buf, offsets, start, end, doc, keep) -> pa.Array:
    """The kept words of each text, joined by one space."""
    n = len(buf)
    last = np.zeros(len(start), bool)
    kept = np.flatnonzero(keep)
    if len(kept):
        last[kept[np.append(doc[kept][1:] != doc[kept][:-1], True)]] = True
    # a kept word's bytes, and the white space after it if another one follows
    edge = np.zeros(n + 2, np.int8)
    edge[start[keep]] += 1
    edge[(end + ~last)[keep]] -= 1
    inside = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    out = buf[inside]
    out[IS_SPACE[out]] = 32
    ends = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])[offsets]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(out)])


def _find(min_length: int):
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = string_bytes(batch.column("text"))
        start, end, doc = word_spans(buf, offsets)
        _, word = np.unique(span_hashes(buf, start, end), return_inverse=True)
        found = runs_of(word, doc, min_length)
        held = doc[found[:, 0]] if len(found) else np.zeros(0, np.int64)
        per_doc = np.bincount(doc, minlength=batch.num_rows)
        before = np.cumsum(per_doc) - per_doc
        # words behind a run's first period: the last end that reaches them
        gone = np.zeros(len(word) + 1, np.int64)
        for a, b, q in found.tolist():
            gone[a + q] += 1
            gone[b] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        fields = [found[:, 0] - before[held], found[:, 1] - found[:, 0], found[:, 2]]
        rows = pa.StructArray.from_arrays([pa.array(x) for x in fields], fields=list(item))
        firsts = np.searchsorted(held, np.arange(batch.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(per_doc), pa.ListArray.from_arrays(pa.array(firsts), rows), _collapse(buf, offsets, start, end, doc, keep)],
            ["doc", "n_words", "runs", "collapsed"],
        )

    return run


def find_runs(docs: DataFrame, *, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, runs, collapsed) of every row: the runs as (start, length,
    period) by start and then period, and the text without the words that repeat a
    run's first period, joined by one space."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(column(id_col).alias("doc"), column(text_col).alias("text"))
    schema = f"doc {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(over_texts(_find(min_length)), schema).withColumnRenamed("doc", id_col)


def longest_power(runs: Column) -> Column:
    """The run with the greatest length by period, the first of equals; null without runs."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
