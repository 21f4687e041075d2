"""LM scoring (5): a hierarchical Pitman-Yor model of words, sampled by Gibbs.

The model. A token's context is the token before it: every word has a restaurant
of its own, whose parent is the one for how the word ends, its last two bytes,
whose parent is the one for the last byte, whose parent is the root over all
tokens, whose base is uniform over the training words and one unknown word. So
there are as many restaurants as words, and 65,536 + 257 above them; their
dishes are all words. Discounts come from the counts of counts of each level,
the concentration is fixed.

Seating. Given the restaurants' totals, words are independent, so the model
is kept in blocks of words (ranges of word hashes), each with all contexts of
its words. A Gibbs sweep draws the number of tables of every dish in every
restaurant from its conditional distribution given its parent without it
(generalised Stirling numbers), leaves first, and passes tables on as the
parents' customers. Blocks sweep side by side with the totals of the round
before; after each round the totals (a few numbers per restaurant) are summed
over the blocks. Those of endings and of the root reach the driver and all tasks.
Those of words are as many as there are words: blocks send theirs to ranges of
contexts, where they are summed, and get back the sums of the contexts they hold.
Only totals go on: seatings restart from one table per dish in
every round, and once more for the answers, whose scores average the predictive
probabilities of the sweeps after BURN_IN.

The data flow. A pass over the texts cuts them into chunks; a chunk holds
its distinct (word, context) pairs, split by block, and per document the
places of its pairs. Blocks merge the pairs of all chunks (the counts and
what each chunk asks for), and answer each chunk; documents add up answers.
Pairs would be more than the texts if they were kept, so a second pass makes the
places of the documents; chunks are marked by what they hold, and a table whose
rows come in another order the second time is refused.
Counts cover all training texts, a pair crosses the network once per chunk
each way, and no list of words reaches the driver. A word in very many chunks
sends its block at most one row per chunk and context.

Defined cases: a null text is empty: one end token, scored like any; words of
no training text have the base's share; with no training text the model is
the base, 1 / (V + 1) = 1 for all; repeated rows count and score each; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, SpanHash, mix, partitions_for, remainder, shared_path, slices, stored, string_bytes, text_bytes, word_spans

CHUNK_TOKENS = 1_000_000
CODEC = pa.Codec("zstd", 1)
BLOCK_TEXT = 8 << 20  # bytes of text for each block of words
PART_BLOCKS = 8  # blocks for each range of word contexts
END = np.uint64(0xE4D0F7E87000E4D1)
HASHED = np.uint64(0xFFFFFFFF)  # the part of a context that is a word's hash
START_CONTEXT = 0xFFFF << 32  # not the end of any UTF-8 word
CONCENTRATION = 1.0
ROUNDS, ROUND_SWEEPS, BURN_IN, SAMPLES = 2, 3, 2, 3
#: Size of the table of Stirling numbers. Dishes of more customers, or that may have more tables, are drawn by
#: limits of the same law (``_seatings``, ``_many_tables``); tests hold all of them against enumeration.
MOST_CUSTOMERS, MOST_TABLES = 4_096, 256


# ------------------------------------------------------- texts to chunks


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, tokens per text): words in lower case and an end after each text's last.
    A context is the token before: its last two bytes, then 32 bits of its hash."""
    buf, offsets = string_bytes(texts)
    buf = ASCII_LOWER[buf]
    start, end, doc = word_spans(buf, offsets)
    n = len(texts)
    words = np.bincount(doc, minlength=n)
    total = len(start) + n
    token, ending = np.empty(total, np.uint64), np.zeros(total, np.uint64)
    at = np.arange(len(start)) + doc
    token[at] = SpanHash(buf)(start, end)
    ends = np.cumsum(words + 1) - 1
    token[ends] = END
    if len(start):
        ending[at] = buf[end - 1].astype(np.uint64) | np.where(end - start > 1, buf[end - 2], 0).astype(np.uint64) << np.uint64(8)
    context = np.empty(total, np.uint64)
    context[1:] = ending[:-1] << np.uint64(32) | token[:-1] & HASHED
    context[np.concatenate([[0], ends[:-1] + 1])] = START_CONTEXT
    return token, context, words + 1


def planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed (high bytes are mostly alike), behind their size."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def unplaned(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    data = CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def kinds_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, which of them each key is)."""
    order = np.argsort(key)  # of equal keys any may come first, which a faster sort allows
    rising = key[order]
    new = np.ones(len(key), bool)
    new[1:] = rising[1:] != rising[:-1]
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return rising[new], order[new], which


def pair_order(w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The order of pairs by w and then c, as of ``lexsort``; equal pairs come as they may."""
    by_c = np.argsort(c)
    rank = kinds_of(w)[2]
    return by_c[np.sort(rank[by_c] << 32 | np.arange(len(w))) & 0xFFFFFFFF]


def chunk_layout(kind: str) -> str:
    return f"chunk long, block int, mark long, ids array<{kind}>, sizes array<int>, places binary, w binary, c binary, n binary"


def _chunk(number: int, ids: list, parts: list, blocks: int, id_type: pa.DataType) -> pa.RecordBatch:
    """One chunk's rows: its pairs by block, or its documents (block -1) where ``blocks`` is 0."""
    token, context, sizes, train = (np.concatenate(x) for x in zip(*parts))
    key, first, which = kinds_of(mix(token + mix(context) * np.uint64(0xD6E8FEB86659FD93)))
    mark = int((mix(key) * np.bincount(which).astype(np.uint64)).sum().view(np.int64))
    w, c = token[first], context[first]
    order = pair_order(w, c)
    place = np.empty(len(w), np.int64)
    place[order] = np.arange(len(w))
    w, c = w[order], c[order]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = place[which]
    columns = ["chunk", "block", "mark", "ids", "sizes", "places", "w", "c", "n"]
    if not blocks:
        # a document's places in rising order, as steps: their sum is all that counts
        key = np.sort(owner * np.int64(len(w)) + place) - owner * np.int64(len(w))
        step = np.diff(key, prepend=0)
        starts = np.cumsum(sizes) - sizes
        step[starts] = key[starts]
        held = [pa.array([ids], pa.list_(id_type)), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([planes(step.astype(np.uint32))], pa.binary())]
        numbers = [pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.array([mark], pa.int64())]
        return pa.RecordBatch.from_arrays([*numbers, *held, *[pa.nulls(1, pa.binary())] * 3], columns)
    n = np.bincount(place[train[owner]], minlength=len(w)).astype(np.uint32)
    block = ((w >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(block, np.arange(blocks + 1))
    some = [b for b in range(blocks) if at[b] < at[b + 1]]
    rows = len(some)
    blob = lambda x: pa.array([planes(x[at[b] : at[b + 1]]) for b in some], pa.binary())
    numbers = [pa.array([number] * rows, pa.int64()), pa.array(some, pa.int32()), pa.array([mark] * rows, pa.int64())]
    held = [pa.nulls(rows, pa.list_(id_type)), pa.nulls(rows, pa.list_(pa.int32())), pa.nulls(rows, pa.binary())]
    return pa.RecordBatch.from_arrays([*numbers, *held, *(blob(x) for x in (w, c, n))], columns)


def _chunks(blocks: int):
    def run(batches):
        task, count, held = TaskContext.get().partitionId(), 0, 0
        ids, parts, id_type = [], [], None
        for batch in batches:
            for part in slices(batch):
                token, context, sizes = tokens_of(part.column("text"))
                ids += part.column("doc").to_pylist()
                id_type = part.schema.field("doc").type
                parts.append((token, context, sizes, part.column("train").to_numpy(zero_copy_only=False)))
                held += len(token)
                if held >= CHUNK_TOKENS:
                    yield _chunk(task << 32 | count, ids, parts, blocks, id_type)
                    ids, parts, held, count = [], [], 0, count + 1
        if parts:
            yield _chunk(task << 32 | count, ids, parts, blocks, id_type)

    return run


# ------------------------------------------------------------- word blocks

BLOCK_LAYOUT = "block int, w binary, c binary, n binary, chunks array<long>, marks array<long>, asked array<binary>"


def _merge(table: pa.Table) -> pa.Table:
    """All chunks' pairs of a block: distinct pairs with their counts, and each chunk's places among them."""
    columns = {k: table.column(k).to_pylist() for k in ("chunk", "mark", "w", "c", "n")}
    w, c, n = ([unplaned(x, kind) for x in columns[k]] for k, kind in (("w", "<u8"), ("c", "<u8"), ("n", "<u4")))
    ends = np.cumsum([len(x) for x in w])
    w, c, n = np.concatenate(w), np.concatenate(c), np.concatenate(n)
    order = pair_order(w, c)
    new = np.ones(len(w), bool)
    new[1:] = (w[order][1:] != w[order][:-1]) | (c[order][1:] != c[order][:-1])
    place = np.empty(len(w), np.uint32)
    place[order] = (np.cumsum(new) - 1).astype(np.uint32)
    first = order[new]
    total = np.bincount(place, weights=n, minlength=len(first)).astype(np.uint64)
    asked = [planes(x) for x in np.split(place, ends[:-1])]
    return pa.table(
        {
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "w": pa.array([planes(w[first])], pa.binary()),
            "c": pa.array([planes(c[first])], pa.binary()), "n": pa.array([planes(total)], pa.binary()),
            "chunks": pa.array([columns["chunk"]], pa.list_(pa.int64())), "marks": pa.array([columns["mark"]], pa.list_(pa.int64())), "asked": pa.array([asked], pa.list_(pa.binary())),
        }
    )


@dataclass
class Totals:
    """What restaurants hold in all: customers and tables by level (0 root, 1 last
    byte, 2 last two bytes; within a block 3, by number of the word context),
    discounts, and the words and tokens of training."""

    customers: list[np.ndarray]
    tables: list[np.ndarray]
    discount: list[float]
    n_words: int
    n_tokens: int

    @property
    def base(self) -> float:
        return 1 / (self.n_words + 1)


class Block:
    """A block of words: for every level of endings its dishes, their customers and tables."""

    def __init__(self, w: bytes, c: bytes, n: bytes):
        words, self.context, self.n = unplaned(w, "<u8"), unplaned(c, "<u2").astype(np.int64), unplaned(n, "<u8").astype(np.int64)
        new = np.ones(len(words), bool)
        new[1:] = words[1:] != words[:-1]
        self.word = np.cumsum(new) - 1
        key = self.word << 8 | self.context & 0xFF
        kinds, self.parent = np.unique(key, return_inverse=True)
        self.parent_word, self.parent_context = kinds >> 8, kinds & 0xFF
        self.n_words = int(new.sum())
        self.word_count = np.bincount(self.word, weights=self.n, minlength=self.n_words).astype(np.int64)
        # one table per dish to begin with
        self.t2 = np.minimum(self.n, 1)
        self._pass_on()
        self.t1 = np.minimum(self.c1, 1)
        self._pass_on()
        self.t0 = np.minimum(self.c0, 1)

    def serve(self, n: np.ndarray) -> None:
        """Other customers, from the level below; tables stay within their numbers."""
        self.n = n
        self.t2 = np.clip(self.t2, np.minimum(n, 1), n)
        self._pass_on()
        self.t1 = np.clip(self.t1, np.minimum(self.c1, 1), self.c1)
        self._pass_on()
        self.t0 = np.clip(self.t0, np.minimum(self.c0, 1), self.c0)

    def _pass_on(self) -> None:
        """Tables of a level are the customers of the next."""
        self.c1 = np.bincount(self.parent, weights=self.t2, minlength=len(self.parent_word)).astype(np.int64)
        if hasattr(self, "t1"):
            self.c0 = np.bincount(self.parent_word, weights=self.t1, minlength=self.n_words).astype(np.int64)

    def levels(self):
        """(context, customers, tables) by level."""
        zero = np.zeros(self.n_words, np.int64)
        return (zero, self.c0, self.t0), (self.parent_context, self.c1, self.t1), (self.context, self.n, self.t2)

    def root(self, totals: Totals) -> np.ndarray:
        return _predict(self.c0, self.t0, totals, 0, np.zeros(self.n_words, np.int64), totals.base)

    def above(self, totals: Totals) -> np.ndarray:
        """The probability that each pair's parent gives its word."""
        p0 = self.root(totals)
        return _predict(self.c1, self.t1, totals, 1, self.parent_context, p0[self.parent_word])[self.parent]

    def predictive(self, totals: Totals) -> np.ndarray:
        """The probability of each pair's word in its context."""
        return _predict(self.n, self.t2, totals, 2, self.context, self.above(totals))

    def sweep(self, totals: Totals, rng: np.random.Generator) -> None:
        """Draws all numbers of tables anew, leaves first."""
        p0 = self.root(totals)
        many = np.flatnonzero(self.n > 1)  # others have as many tables as customers
        parent, own = self.parent[many], self.t2[many]
        rest = self.c1[parent] - own  # the parent's customers without this dish's tables
        p1 = _predict(rest, np.minimum(self.t1[parent], rest), totals, 1, self.parent_context[parent], p0[self.word[many]], own)
        self.t2[many] = draw_tables(self.n[many], own, p1, totals, 2, self.context[many], rng)
        self._pass_on()
        self.t1 = np.clip(self.t1, np.minimum(self.c1, 1), self.c1)
        own = self.t1
        rest = self.c0[self.parent_word] - own
        up = np.zeros(len(own), np.int64)
        p = _predict(np.maximum(rest, 0), np.clip(rest, 0, self.t0[self.parent_word]), totals, 0, up, totals.base, own)
        self.t1 = draw_tables(self.c1, own, p, totals, 1, self.parent_context, rng)
        self._pass_on()
        self.t0 = np.clip(self.t0, np.minimum(self.c0, 1), self.c0)
        self.t0 = draw_tables(self.c0, self.t0, np.full(self.n_words, totals.base), totals, 0, np.zeros(self.n_words, np.int64), rng)


class WordBlock:
    """A block of words with the contexts of whole words, above the levels of their endings.
    ``contexts`` are its word contexts, by hash and then ending; totals of level 3 are in this order."""

    def __init__(self, w: bytes, c: bytes, n: bytes):
        words, context, self.n = unplaned(w, "<u8"), unplaned(c, "<u8"), unplaned(n, "<u8").astype(np.int64)
        self.contexts, self.context = np.unique((context & HASHED) << np.uint64(16) | context >> np.uint64(32), return_inverse=True)
        ending = (context >> np.uint64(32)).astype(np.uint16)
        new_word = np.ones(len(words), bool)
        new_word[1:] = words[1:] != words[:-1]
        new = new_word.copy()
        new[1:] |= ending[1:] != ending[:-1]
        self.parent = np.cumsum(new) - 1
        word = np.cumsum(new_word) - 1
        self.word_count = np.bincount(word, weights=self.n).astype(np.int64)[word]
        self.t = np.minimum(self.n, 1)  # one table per dish to begin with
        self.many = np.flatnonzero(self.n > 1)  # others have as many tables as customers
        self.endings = Block(planes(words[new]), planes(ending[new]), planes(self._passed().astype(np.uint64)))

    def _passed(self) -> np.ndarray:
        return np.bincount(self.parent, weights=self.t).astype(np.int64)

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """(customers, tables) of each word context."""
        return tuple(np.bincount(self.context, weights=x, minlength=len(self.contexts)).astype(np.int64) for x in (self.n, self.t))

    def predictive(self, totals: Totals) -> np.ndarray:
        """The probability of each pair's word in its context."""
        return _predict(self.n, self.t, totals, 3, self.context, self.endings.predictive(totals)[self.parent])

    def sweep(self, totals: Totals, rng: np.random.Generator) -> None:
        """Draws all numbers of tables anew, leaves first."""
        up, many = self.endings, self.many
        parent, own = self.parent[many], self.t[many]
        rest = up.n[parent] - own  # the parent's customers without this dish's tables
        p = _predict(rest, np.minimum(up.t2[parent], rest), totals, 2, up.context[parent], up.above(totals)[parent], own)
        self.t[many] = draw_tables(self.n[many], own, p, totals, 3, self.context[many], rng)
        up.serve(self._passed())
        up.sweep(totals, rng)


def _predict(customers, tables, totals: Totals, level: int, context, lower, without=0):
    """Pitman-Yor predictive probability; an empty restaurant passes on its parent's."""
    d, all_customers, all_tables = totals.discount[level], totals.customers[level][context], totals.tables[level][context]
    everyone = np.maximum(all_customers - without, 0)
    weight = CONCENTRATION + d * np.minimum(all_tables, np.maximum(everyone, 0))
    return (np.maximum(customers - d * tables, 0) + weight * lower) / (CONCENTRATION + everyone)


@lru_cache(maxsize=4)  # a table for each level
def stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers, ways to seat n customers at 1, 2, ... tables, less
    that of one table, up to MOST_CUSTOMERS and MOST_TABLES."""
    out = np.full((MOST_CUSTOMERS + 1, MOST_TABLES + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(MOST_TABLES + 1)
    for n in range(MOST_CUSTOMERS):
        room = n - t * d
        out[n + 1] = np.where(room > 0, np.log(np.maximum(room, 1e-300)) + out[n], -np.inf)
        out[n + 1, 1:] = np.logaddexp(out[n + 1, 1:], out[n, :-1])
    out[1:] -= out[1:, 1:2].copy()
    return out[:, 1:]


def _seatings(d: float, n: np.ndarray, most: int) -> np.ndarray:
    """log of the Stirling numbers of each n for 1 to ``most`` tables, less that of one table.
    Beyond MOST_CUSTOMERS they hardly change any more: they are smooth in n to the
    power of -d, and carried on along it."""
    table = stirling(d)[:, :most]
    out = table[np.minimum(n, MOST_CUSTOMERS)]
    large = np.flatnonzero(n > MOST_CUSTOMERS)
    if len(large):
        far, near = float(MOST_CUSTOMERS) ** -d, float(MOST_CUSTOMERS // 4) ** -d
        slope = (table[MOST_CUSTOMERS] - table[MOST_CUSTOMERS // 4]) / (far - near)
        out[large] = table[MOST_CUSTOMERS] + slope * (n[large].astype(float) ** -d - far)[:, None]
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function above 1, by its series beyond 7."""
    far = x + 7
    out = (far - 0.5) * np.log(far) - far + np.log(2 * np.pi) / 2 + 1 / (12 * far) - 1 / (360 * far**3)
    for k in range(7):
        out = out - np.log(x + k)
    return out


def _one_large_table(t: np.ndarray, n: np.ndarray, d: float) -> np.ndarray:
    """log of the coefficients, where t is at most n^d."""

    def reciprocal(x):  # of the gamma function
        try:
            return 1 / math.gamma(x)
        except (ValueError, OverflowError):
            return 0.0

    total, term = np.zeros_like(t), np.ones_like(t)
    for j in range(1, 60):
        total += term * reciprocal(-d * j) / reciprocal(-d)
        term = -term * (t - j) * np.minimum(n**-d, 1 / t) / (j + 1)
    return np.log(np.maximum(total, 1e-300)) + np.log(t * d) - math.lgamma(1 - d) - (1 + d) * np.log(n)


def _many_tables(n, weight, p, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables where they may be hundreds. Ways to seat are the coefficients of
    (1 - (1 - x)^d)^t, read at their saddle point: u = 1 - x stands for t, which rises with
    it. Where t is small against n^d one table holds nearly all customers, there is no such
    point, and a series in t / n^d is summed instead. The law is computed from eight
    deviations below its mode to ten above, and inverted."""

    def tables(u, n):
        return n * -np.expm1(d * np.log(u)) * u ** (1 - d) / ((1 - u) * d)

    def slope(u, t, weight, p):
        return np.log(-np.expm1(d * np.log(u))) - np.log(d * (t + 0.5)) + np.log((weight + d * t) * p)

    def solved(above, shape):  # the largest log u that is not above
        low, high = np.full(shape, -700.0), np.full(shape, -1e-12)
        for _ in range(60):
            mid = (low + high) / 2
            up = above(np.exp(mid))
            low, high = np.where(up, low, mid), np.where(up, mid, high)
        return np.exp(low)

    mode = solved(lambda u: slope(u, tables(u, n), weight, p) < 0, len(n))
    a, b = mode ** 1.001, mode ** 0.999
    ta, tb = tables(a, n), tables(b, n)
    bend = (slope(b, tb, weight, p) - slope(a, ta, weight, p)) / np.maximum(tb - ta, 1e-9)
    wide = 1 / np.sqrt(np.maximum(-bend, 1e-12))
    n, weight, p = n[:, None], weight[:, None], p[:, None]
    t = np.clip(tables(mode, n[:, 0])[:, None] + wide[:, None] * np.linspace(-8, 10, 181), 0.5, n - 1e-6)
    u = solved(lambda u: tables(u, n) > t, t.shape)
    gap = np.diff(t, axis=1)
    power = np.exp(d * np.log(u))
    ratio = n / t
    spread = -(1 - u) * ratio * (-1 / (1 - u) + ((d - 1) + d * power / (1 - power)) / u)
    log_p = t * np.log1p(-power) - n * np.log1p(-u) - np.log(2 * np.pi * np.maximum(t * spread, 1e-300)) / 2
    log_p = np.where(t * n**-d <= 1, _one_large_table(t, n, d), log_p)
    log_p += t * np.log(p) + _log_gamma(weight / d + t) - _log_gamma(t + 1)
    height = np.exp(log_p - log_p.max(axis=1, keepdims=True))
    share = np.cumsum(np.pad((height[:, 1:] + height[:, :-1]) / 2 * gap, ((0, 0), (1, 0))), axis=1)
    want = rng.random((len(n), 1)) * share[:, -1:]
    at = np.clip((share < want).sum(axis=1), 1, t.shape[1] - 1)
    row = np.arange(len(n))
    part = (want[:, 0] - share[row, at - 1]) / np.maximum(share[row, at] - share[row, at - 1], 1e-300)
    return np.clip(np.rint(t[row, at - 1] + part * gap[row, at - 1]), 1, n[:, 0]).astype(np.int64)


def draw_tables(n, old, p, totals: Totals, level: int, context, rng: np.random.Generator) -> np.ndarray:
    """A number of tables for each dish of ``n`` customers whose parent gives it
    probability ``p``, given all other dishes of its restaurant: t has weight
    S(n, t) p^t times the product of CONCENTRATION + d (others + k) for k < t."""
    d = totals.discount[level]
    out = np.minimum(n, 1).astype(np.int64)
    rows = np.flatnonzero(n > 1)
    if not len(rows):
        return out
    weight = CONCENTRATION + d * np.maximum(totals.tables[level][context] - old, 0)[rows].astype(np.float64)
    p, n = np.clip(p[rows], 1e-300, 1 - 1e-12), n[rows]
    # with ever more customers the number follows a negative binomial law, which bounds it
    mean = (weight / d + 1) * p / (1 - p)
    most = np.minimum(n, np.ceil(2 + mean + 9 * np.sqrt(mean / (1 - p)) + 8 / (1 - p)))
    done = 0
    for size in (4, 8, 16, 32, 64, 128, MOST_TABLES):
        here = np.flatnonzero((most > done) & (most <= size))
        for part in np.array_split(here, max(1, -(-len(here) * size // (1 << 20)))):  # matrices of some 8 MB
            t = np.arange(size)
            log_p = np.cumsum(np.log(weight[part, None] + d * t), axis=1) + t * np.log(p[part, None]) + _seatings(d, n[part], size)
            share = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
            out[rows[part]] = 1 + (share < rng.random((len(part), 1)) * share[:, -1:]).sum(axis=1)
        done = size
    here = np.flatnonzero(most > MOST_TABLES)
    if len(here):
        for part in np.array_split(here, -(-len(here) // 256)):
            out[rows[part]] = _many_tables(n[part].astype(float), weight[part], p[part], d, rng)
    return out


# --------------------------------------------------------------- totals

#: Rows of levels, and rows of word contexts: those of one block in one range of contexts.
TOTALS_LAYOUT = "level int, context int, customers long, tables long, ones long, twos long, part int, block int, c binary, n binary, t binary"
TOTALS_KINDS = [*[pa.int32()] * 2, *[pa.int64()] * 4, *[pa.int32()] * 2, *[pa.binary()] * 3]
TOTALS_NAMES = ["level", "context", "customers", "tables", "ones", "twos", "part", "block", "c", "n", "t"]
SUMS_LAYOUT = "block int, part int, n binary, t binary"


def _count_block(block: WordBlock, number: int, parts: int) -> pa.Table:
    rows = []
    levels = (*block.endings.levels(), (np.zeros(len(block.n), np.int64), block.n, block.t))  # of words, only the sums
    for level, (context, customers, tables) in enumerate(levels):
        kinds = np.unique(context)
        at = np.searchsorted(kinds, context)
        sums = [np.bincount(at, weights=x, minlength=len(kinds)).astype(np.int64) for x in (customers, tables, customers == 1, customers == 2)]
        rows.append([np.full(len(kinds), level), kinds, *sums])
    rows = [np.concatenate(x) for x in zip(*rows)]
    of_levels = pa.table([*(pa.array(x, k) for x, k in zip(rows, TOTALS_KINDS)), *(pa.nulls(len(rows[0]), k) for k in TOTALS_KINDS[6:])], TOTALS_NAMES)
    customers, tables = block.held()
    part = ((block.contexts >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    some = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
    blob = lambda x: pa.array([planes(x[cuts[k] : cuts[k + 1]]) for k in some], pa.binary())
    steps = pa.array([planes(np.diff(block.contexts[cuts[k] : cuts[k + 1]], prepend=np.uint64(0))) for k in some], pa.binary())
    of_words = [pa.array(some, pa.int32()), pa.array([number] * len(some), pa.int32()), steps, blob(customers), blob(tables)]
    return pa.concat_tables([of_levels, pa.table([*(pa.nulls(len(some), k) for k in TOTALS_KINDS[:6]), *of_words], TOTALS_NAMES)])


def _add_words(table: pa.Table) -> pa.Table:
    """The totals of a range of word contexts, for each block those of the contexts that it holds."""
    of = {k: table.column(k).to_pylist() for k in ("block", "part", "c", "n", "t")}
    keys = [np.cumsum(unplaned(x, "<u8")) for x in of["c"]]
    ends = np.cumsum([len(x) for x in keys])[:-1]
    kinds, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = []
    for k in ("n", "t"):
        sums = np.bincount(at, weights=np.concatenate([unplaned(x, "<i8") for x in of[k]]), minlength=len(kinds)).astype(np.int64)
        out.append(pa.array([planes(x) for x in np.split(sums[at], ends)], pa.binary()))
    return pa.table([pa.array(of["block"], pa.int32()), pa.array(of["part"], pa.int32()), *out], ["block", "part", "n", "t"])


def _with_words(totals: Totals, sums: pa.Table) -> Totals:
    """``totals`` with those of a block's word contexts."""
    order = np.argsort(sums.column("part").to_numpy())
    customers, tables = (sums.column(k).to_pylist() for k in ("n", "t"))
    both = (np.concatenate([unplaned(x[k], "<i8") for k in order]) for x in (customers, tables))
    return replace(totals, **{k: [*getattr(totals, k), x] for k, x in zip(("customers", "tables"), both)})


def _numbered(block: pa.Table):
    return (block.column("block")[0].as_py(), *(block.column(k)[0].as_py() for k in ("w", "c", "n")))


def _round(blocks: DataFrame, before: Totals | None, words: DataFrame | None, parts: int) -> tuple[Totals, DataFrame]:
    """The restaurants' totals after the sweeps of a round (None: as first seated): those of
    endings, of which at most 65,793 rows reach the driver, and those of words by block."""
    held = blocks.sparkSession.sparkContext.broadcast(before)

    def first(batches):
        for batch in batches:
            for number, *blobs in zip(*(batch.column(k).to_pylist() for k in ("block", "w", "c", "n"))):
                yield from _count_block(WordBlock(*blobs), number, parts).to_batches()

    def later(block: pa.Table, sums: pa.Table) -> pa.Table:
        number, *blobs = _numbered(block)
        block, totals = WordBlock(*blobs), _with_words(held.value, sums)
        rng = np.random.default_rng([number, totals.n_tokens])
        for _ in range(ROUND_SWEEPS):
            block.sweep(totals, rng)
        return _count_block(block, number, parts)

    narrow = blocks.select("block", "w", "c", "n")
    if before is None:
        found = narrow.mapInArrow(first, TOTALS_LAYOUT)
    else:
        found = narrow.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(later, TOTALS_LAYOUT)
    found = stored(found, "totals")
    rows = found.where("level IS NOT NULL").groupBy("level", "context")
    rows = rows.agg(*(F.sum(c).alias(c) for c in ("customers", "tables", "ones", "twos"))).toArrow()
    level, context, customers, tables, ones, twos = (rows.column(k).to_numpy() for k in rows.column_names)
    out = Totals([], [], [], 0, 0)
    for k, size in enumerate((1, 1 << 8, 1 << 16, None)):
        here = level == k
        for list_, values in ((out.customers, customers), (out.tables, tables)):
            if size:
                list_.append(np.zeros(size, np.int64))
                list_[-1][context[here]] = values[here]
        n1, n2 = ones[here].sum(), twos[here].sum()
        out.discount.append(before.discount[k] if before else float(np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.05, 0.95)))
    out.n_tokens = int(customers[level == 3].sum())
    out.n_words = before.n_words if before else int(out.tables[0].sum())  # one table for each word at first
    sums = found.where("part IS NOT NULL").select("part", "block", "c", "n", "t").groupBy("part").applyInArrow(_add_words, SUMS_LAYOUT)
    return out, sums


# ------------------------------------------------------------- answers

ANSWER_LAYOUT = "chunk long, block int, mark long, score binary, count binary"


def _answers(totals):
    def run(block: pa.Table, sums: pa.Table) -> pa.Table:
        number, *blobs = _numbered(block)
        chunks, marks, asked = (block.column(k)[0].as_py() for k in ("chunks", "marks", "asked"))
        words, whole, rng = WordBlock(*blobs), _with_words(totals.value, sums), np.random.default_rng([number, 5])
        p = np.zeros(len(words.n))
        for k in range(BURN_IN + SAMPLES):
            words.sweep(whole, rng)
            if k >= BURN_IN:
                p += words.predictive(whole) / SAMPLES
        score, count = np.log10(p).astype(np.float32), words.word_count
        places = [unplaned(x, "<u4") for x in asked]
        out = [[planes(x[at]) for at in places] for x in (score, count)]
        kinds = [pa.array(chunks, pa.int64()), pa.array([number] * len(chunks), pa.int32()), pa.array(marks, pa.int64())]
        return pa.table([*kinds, *(pa.array(x, pa.binary()) for x in out)], ["chunk", "block", "mark", "score", "count"])

    return run


def _add_up(totals, kind_of: pa.DataType):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if docs.num_rows != 1 or not answers.num_rows or set(answers.column("mark").to_pylist()) != set(docs.column("mark").to_pylist()):
            raise ValueError("rows came in another order when they were read again; store the table first")
        order = np.argsort(answers.column("block").to_numpy())
        score, count = (answers.column(k).to_pylist() for k in ("score", "count"))
        score = np.concatenate([unplaned(score[k], "<f4") for k in order]).astype(np.float64)
        count = np.concatenate([unplaned(count[k], "<i8") for k in order])
        sizes = np.array(docs.column("sizes")[0].as_py(), np.int64)
        starts = np.cumsum(sizes) - sizes
        step = unplaned(docs.column("places")[0].as_py(), "<u4").astype(np.int64)
        run_ = np.cumsum(step)
        place = run_ - np.repeat(run_[starts] - step[starts], sizes)
        n, v = totals.value.n_tokens, totals.value.n_words
        add = lambda x: np.add.reduceat(x[place], starts)
        return pa.table(
            {
                "doc": pa.array(docs.column("ids")[0].as_py(), kind_of), "n_tokens": pa.array(sizes), "n_known": pa.array(add((count > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(sizes), n)), "base_score": pa.array(add(np.log10(count + 0.5)) - sizes * np.log10(n + 0.5 * (v + 1))),
                "score": pa.array(add(score)),
            }
        )

    return run


def _in_buckets(blocks: DataFrame, n: int) -> DataFrame:
    """``blocks`` written to the shared folder in ``n`` buckets by block, so that what is summed for
    blocks comes to them and they stay where they are. The table's name is given up at once."""
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    blocks.write.format("parquet").option("path", shared_path(spark, "blocks")).bucketBy(n, "block").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def score_texts(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_tokens, n_known, train_tokens, base_score, score, perplexity) of
    every row; ``train`` is the condition on rows that the model learns from.

    Scores are log10 probabilities: ``base_score`` of add-half unigrams,
    ``score`` of the model."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    blocks_n = partitions_for(spark, text_bytes(docs, text_col), BLOCK_TEXT)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = lambda n: rows.mapInArrow(_chunks(n), chunk_layout(kind.simpleString()))
    pairs = chunks(blocks_n).select("chunk", "block", "mark", "w", "c", "n")
    blocks = _in_buckets(pairs.groupBy("block").applyInArrow(_merge, BLOCK_LAYOUT), blocks_n)
    totals, words = None, None
    for _ in range(ROUNDS + 1):
        totals, words = _round(blocks, totals, words, -(-blocks_n // PART_BLOCKS))
    held = spark.sparkContext.broadcast(totals)
    answers = blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_answers(held), ANSWER_LAYOUT)
    texts = chunks(0).select("chunk", "mark", "ids", "sizes", "places")
    from pyspark.sql.pandas.types import to_arrow_type

    layout = f"doc {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_add_up(held, to_arrow_type(kind)), layout)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("doc", id_col)


def training_rows(id_col: str = "doc_id"):
    """The rows that op5 learns from: crc32 of the id as text, modulo 5, is not 1."""
    return remainder(5, id_col) != 1
