"""Byte-level BPE encoding and decoding (7).

Pre-tokenisation without a regular expression: every code point becomes one
of a few symbols (its class, and for white space and contraction letters what
follows it). A small automaton over those symbols says where a piece starts.
A symbol is a function from state to state; composing such functions is
associative, so all blocks of a buffer compose theirs side by side, one short
pass over the blocks gives each block's entry state, and all blocks replay
side by side to mark the starts.

The slices between starts feed pair merging through a cache; slices that the
cache lacks are merged together, a row of a matrix each, the lowest-ranked
leftmost pair of every row per round. Slice and token offsets are kept, so
that decoding is a gather of token bytes.

Defined cases: null and empty texts have no ids; texts of any length are
encoded whole; repeated rows give a row each; an empty table an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, over_texts

# ------------------------------------------------------------ pre-tokenising

# The symbols and states of the automaton for the public pattern
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, SHORT, LONG, NUMBER, OTHER, QUOTE, LAST_BLANK, LAST_SPACE, SPACE = range(9)
FRESH, IN_LETTERS, IN_NUMBER, IN_OTHER, AT_QUOTE, IN_LONG, AT_BLANK, IN_SPACE = range(8)
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
N_STATES, N_SYMBOLS, BLOCK, COMPOSED = 8, 9, 256, 32


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece start here) by symbol and state. A symbol plus
    N_SYMBOLS is the same at the start of a text, where any state is FRESH."""
    to = np.zeros((N_SYMBOLS, N_STATES), np.uint8)
    starts = np.ones((N_SYMBOLS, N_STATES), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (SHORT, IN_LETTERS), (LONG, IN_LETTERS), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
        to[symbol] = state
        starts[symbol, [state, AT_BLANK]] = False
    to[SHORT, AT_QUOTE], starts[SHORT, AT_QUOTE] = FRESH, False
    to[LONG, AT_QUOTE], starts[LONG, AT_QUOTE] = IN_LONG, False
    for symbol in (LETTER, SHORT, LONG):
        to[symbol, IN_LONG], starts[symbol, IN_LONG] = FRESH, False
    starts[OTHER, AT_QUOTE] = False
    to[QUOTE] = AT_QUOTE
    to[QUOTE, [IN_OTHER, AT_QUOTE, AT_BLANK]] = IN_OTHER
    starts[QUOTE, [IN_OTHER, AT_QUOTE, AT_BLANK]] = False
    to[LAST_BLANK], to[LAST_SPACE], to[SPACE] = AT_BLANK, FRESH, IN_SPACE
    starts[SPACE, IN_SPACE] = False
    first = np.repeat(to[:, :1], N_STATES, axis=1)
    return np.vstack([to, first]).ravel(), np.vstack([starts, np.ones_like(starts)]).ravel()


NEXT, STARTS = _automaton()


@cache
def code_point_classes() -> np.ndarray:
    """The symbol of every code point, as far as it doesn't hang on what follows."""
    kind = np.array([unicodedata.category(chr(i))[0] for i in range(0x110000)])
    out = np.full(0x110000, OTHER, np.uint8)
    out[kind == "L"], out[kind == "N"], out[SPACES] = LETTER, NUMBER, SPACE
    out[[ord(c) for c in "stmd"]] = SHORT
    out[ord("'")] = QUOTE
    return out


def _symbols(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    s = code_point_classes()[points]
    last = text_starts[text_starts > 0] - 1  # the last of each text but the final one
    space = s == SPACE
    ends_run = space.copy()  # white space with something else after it in its text
    ends_run[:-1] &= ~space[1:]
    ends_run[last] = ends_run[-1] = False
    at = np.flatnonzero(ends_run)
    s[at] = np.where(points[at] == 0x20, LAST_BLANK, LAST_SPACE).astype(np.uint8)
    at = np.flatnonzero(s[:-1] == QUOTE) + 1  # only letters after a quote can make a contraction
    at = np.setdiff1d(at, last + 1)
    at = at[(at < len(points) - 1) & ~np.isin(at, last)]
    for c, then in ("re", "ve", "ll"):
        s[at[(points[at] == ord(c)) & (points[at + 1] == ord(then))]] = LONG
    s[text_starts] += N_SYMBOLS
    return s


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of some texts that follow each other."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    symbols = np.full(blocks * BLOCK, SPACE, np.uint8)
    symbols[:n] = _symbols(points, text_starts)
    rows = np.ascontiguousarray(symbols.reshape(blocks, BLOCK).T)
    # Each block's function, composed symbol by symbol. A blank between words
    # sends every state to one, so most functions are constant before long and
    # are then followed as a single state; the others stay whole.
    whole = np.tile(np.arange(N_STATES, dtype=np.uint8), (blocks, 1))
    for row in rows[:COMPOSED]:
        whole = NEXT[(row * np.uint8(N_STATES))[:, None] + whole]
    many = np.flatnonzero((whole != whole[:, :1]).any(axis=1))
    some, single = whole[many], whole[:, 0].copy()
    for row in rows[COMPOSED:]:
        step = row * np.uint8(N_STATES)
        single = NEXT[step + single]
        if len(many):
            some = NEXT[step[many][:, None] + some]
    whole = np.repeat(single[:, None], N_STATES, axis=1)
    whole[many] = some
    entry, state = np.empty(blocks, np.uint8), FRESH
    for k, f in enumerate(whole.tolist()):
        entry[k] = state
        state = f[state]
    marks = np.empty((BLOCK, blocks), bool)
    for k, row in enumerate(rows):
        at = row * np.uint8(N_STATES) + entry
        marks[k] = STARTS[at]
        entry = NEXT[at]
    return np.flatnonzero(marks.T.reshape(-1)[:n])


# ------------------------------------------------------------------ merging

WIDTHS = (8, 16, 32)  # bytes of the slices merged in one matrix; longer ones are merged by a heap
ROWS = 4096
CACHE_SLICES = 150_000
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the json files: a printable byte is
    itself, the others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of one vocabulary file (.tiktoken ranks, or .json)."""

    def __init__(self, file: str):
        pairs: dict[int, int] = {}
        self.special: dict[str, int] = {}
        self.whole: dict[bytes, int] = {}
        if file.endswith(".json"):
            with open(file, encoding="utf-8") as f:
                model = json.load(f)
            letters = byte_letters()
            names = model["model"]["vocab"]
            self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
            ids = {bytes(map(letters.__getitem__, s)): i for s, i in names.items() if s not in self.special}
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
            self.id_of_rank = np.array([names[a + b] for a, b in merges], np.int32)
            for rank, (a, b) in enumerate(merges):
                pairs.setdefault(names[a] << 16 | names[b], rank)
        else:
            with open(file, "rb") as f:
                ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.whole = ids
            self.id_of_rank = np.arange(max(ids.values()) + 1, dtype=np.int32)
            for token, rank in ids.items():
                for k in range(1, len(token)):
                    if (a := ids.get(token[:k])) is not None and (b := ids.get(token[k:])) is not None:
                        pairs[a << 16 | b] = rank
        if max(ids.values()) >= 1 << 16:
            raise ValueError("pairs of ids are kept in 32 bits: vocabularies of more than 65,536 tokens are not supported")
        self.pairs = pairs
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        self._fill_slots(np.fromiter(pairs, np.uint32, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        ids |= {s.encode(): i for s, i in self.special.items()}
        n = max(ids.values()) + 1
        by_id = [b""] * n
        for token, i in ids.items():
            by_id[i] = token
        self.bytes_table = Ragged(by_id)
        self.decimal_table = Ragged([b"%d " % i for i in range(n)])
        self.known: dict[bytes, int] = {}  # slice -> its place in the store of ids
        self.store, self.store_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> Encoded:
        """Ids of whole texts, with the places of slices and ids."""
        if self.special:  # as the library that reads .json does: its special strings are ids of their own
            return self._encode_with_special(texts)
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> Encoded:
        joined = "".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        text_starts = np.concatenate([[0], ends[:-1]])
        starts = piece_starts(points, np.unique(text_starts[text_starts < len(points)]))
        raw = joined.encode()
        buf = np.frombuffer(raw, np.uint8)
        at = np.append(np.flatnonzero((buf & 0xC0) != 0x80)[starts], len(buf))  # in bytes
        # equal slices meet by hash; one of each is looked up as bytes
        _, first, which = np.unique(SpanHash(buf)(at[:-1], at[1:]), return_index=True, return_inverse=True)
        place = self._places([raw[a:b] for a, b in zip(at[first].tolist(), at[first + 1].tolist())])[which]
        size = self.store_at[place + 1] - self.store_at[place]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.store[runs(self.store_at[place], size)]
        return Encoded(ids, before[np.searchsorted(starts, np.concatenate([[0], ends]))], starts, before)

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Where each slice's ids are in the store; those it lacks are merged and added."""
        missing = [p for p in pieces if p not in self.known]
        if missing:
            if len(self.known) + len(missing) > CACHE_SLICES:
                self.known, self.store, self.store_at, missing = {}, self.store[:0], self.store_at[:1], pieces
            ids = self.merge(missing)
            n = len(self.known)
            self.known.update(zip(missing, range(n, n + len(missing))))
            self.store = np.concatenate([self.store, np.frombuffer(b"".join(ids), "<u4")])
            grown = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4) + self.store_at[-1]
            self.store_at = np.concatenate([self.store_at, grown])
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _encode_with_special(self, texts: list[str]) -> Encoded:
        if not any(s in t for t in texts for s in self.special):
            return self._encode(texts)
        parts, owner = [], []  # a part is a text or the id of a special string
        for k, t in enumerate(texts):
            for part in _split_on(t, list(self.special)):
                parts.append(self.special.get(part, part) if part in self.special else part)
                owner.append(k)
        plain = self._encode([p for p in parts if isinstance(p, str)])
        runs, k = [[] for _ in texts], 0
        for part, text in zip(parts, owner):
            if isinstance(part, str):
                runs[text].append(plain.text(k))
                k += 1
            else:
                runs[text].append(np.array([part], "<u4"))
        each = [np.concatenate(r) if r else np.zeros(0, "<u4") for r in runs]
        bounds = np.concatenate([[0], np.cumsum([len(e) for e in each])])
        return Encoded(np.concatenate(each) if each else plain.ids, bounds, None, None)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes, where each id's bytes end)."""
        return self.bytes_table.join(ids)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian, 4 bytes each) of each slice."""
        out: list[bytes | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            out[k] = np.array(self._merge_long(words[k]), "<u4").tobytes()
        for least, width in zip((-1, *WIDTHS), WIDTHS):
            rows = np.flatnonzero((sizes > least) & (sizes <= width)).tolist()
            for k in range(0, len(rows), ROWS):
                part = rows[k : k + ROWS]
                for row, ids in zip(part, self._merge_rows([words[r] for r in part], width)):
                    out[row] = ids
        if self.whole:  # a slice that is a token stays one, whatever its merges
            for k, w in enumerate(words):
                if (i := self.whole.get(w)) is not None:
                    out[k] = i.to_bytes(4, "little")
        return out

    def _fill_slots(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """A hash table of pairs as arrays: a key lies in the first free slot after its own."""
        bits = int(len(keys) * 3).bit_length()
        self.shift, self.probes = np.uint32(32 - bits), 0
        self.slots, self.slot_ranks = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.full(1 << bits, NONE, np.int32)
        rest, step = np.arange(len(keys)), 0
        while len(rest):
            at = self._slot(keys[rest], step)
            free = self.slots[at] == 0xFFFFFFFF
            at, row = np.unique(at[free], return_index=True)
            won = rest[free][row]
            self.slots[at], self.slot_ranks[at] = keys[won], ranks[won]
            rest = np.setdiff1d(rest, won)
            step += 1
        self.probes = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1) >> self.shift) + np.uint32(step)) & np.uint32(len(self.slots) - 1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where they don't merge or one is missing (-1)."""
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        keys[(left < 0) | (right < 0)] = 0xFFFFFFFF
        out = np.full(keys.shape, NONE, np.int32)
        rest, keys = np.flatnonzero(keys.ravel() != 0xFFFFFFFF), keys.ravel()
        flat = out.ravel()
        for step in range(self.probes):
            at = self._slot(keys[rest], step)
            held = self.slots[at]
            hit = held == keys[rest]
            flat[rest[hit]] = self.slot_ranks[at[hit]]
            rest = rest[~hit & (held != 0xFFFFFFFF)]
            if not len(rest):
                break
        return flat.reshape(out.shape)

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = np.full((n, width), NONE, np.int32)  # of the pair that starts in a column
        ranks[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        live, done = np.arange(n), np.empty((n, width), np.int32)
        while len(live):
            row, at = np.arange(len(live)), ranks.argmin(axis=1)
            best = ranks[row, at]
            over = best == NONE
            if over.any():
                done[live[over]] = ids[over]
                keep = np.flatnonzero(~over)
                live, ids, ranks, at, best, row = live[keep], ids[keep], ranks[keep], at[keep], best[keep], row[: len(keep)]
            right = column > at[:, None]
            ids[:, :-1] = np.where(right[:, :-1], ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(right[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, NONE
            merged = ids[row, at] = self.id_of_rank[best]
            after = ids[row, np.minimum(at + 1, width - 1)]
            after[at + 1 >= width] = -1
            before = ids[row, np.maximum(at - 1, 0)]
            before[at == 0] = -1
            new = self._rank(np.concatenate([merged, before]), np.concatenate([after, merged]))
            ranks[row, at] = new[: len(row)]
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = new[len(row) :][inner]
        held = done >= 0
        flat = done[held].astype("<u4").tobytes()
        ends = (np.cumsum(held.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, word: bytes) -> list[int]:
        """One long slice: a heap of pairs over a linked list, lowest rank and leftmost first."""
        ids = self.byte_ids[list(word)].tolist()
        n, nxt, prev = len(ids), [*range(1, len(ids) + 1)], [*range(-1, len(ids) - 1)]
        rank = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = int(self.id_of_rank[r]), -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := rank(ids[i] << 16 | ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := rank(ids[p] << 16 | ids[i])) is not None:
                heapq.heappush(heap, (r, p, ids[p], ids[i]))
        return [i for i in ids if i >= 0]


@dataclass
class Encoded:
    """ids of some texts; ``bounds`` has each text's first id, ``starts`` each
    slice's first code point and ``before`` each slice's first id."""

    ids: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray | None
    before: np.ndarray | None

    def text(self, k: int) -> np.ndarray:
        return self.ids[self.bounds[k] : self.bounds[k + 1]]


class Ragged:
    """Byte strings by number, joined by one gather."""

    def __init__(self, items: list[bytes]):
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(items), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        size = self.size[ids]
        return self.data[runs(self.start[ids], size)].tobytes(), np.cumsum(size)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then the same of the next."""
    start, size = start[size > 0], size[size > 0]
    if not len(size):
        return np.zeros(0, np.int64)
    at = np.ones(size.sum(), np.int64)  # steps of one, but for the jumps between runs
    at[0] = start[0]
    at[np.cumsum(size)[:-1]] = start[1:] - (start + size)[:-1] + 1
    return np.cumsum(at, out=at)


def _split_on(text: str, marks: list[str]) -> list[str]:
    """The text cut before and after every mark (leftmost, then longest)."""
    out, at = [], 0
    while True:
        found = [(text.find(m, at), -len(m), m) for m in marks]
        found = min((f for f in found if f[0] >= 0), default=None)
        if found is None:
            return [*out, text[at:]] if at < len(text) else out
        if found[0] > at:
            out.append(text[at : found[0]])
        out.append(found[2])
        at = found[0] + len(found[2])


@cache
def encoder(file: str) -> ByteBPE:
    """One encoder, with its cache of slices, for each file and Python worker."""
    return ByteBPE(file)


# ------------------------------------------------------------------- Spark


def _round_trip(file: str, id_col: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(file)
        coded = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
        counts, ids_hash, text_hash = np.diff(coded.bounds), [], []
        for k in range(batch.num_rows):
            ids = coded.text(k)
            ids_hash.append(hashlib.sha256(bpe.decimal_table.join(ids)[0][:-1]).hexdigest())
            text_hash.append(hashlib.sha256(bpe.decode(ids)[0]).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
            [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return over_texts(run)


def round_trips(docs: DataFrame, file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids: (``id_col``, n_tokens, ids_sha256, decoded_sha256)."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")) if id_col != "text" else docs
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        _round_trip(file, id_col), f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode_documents(docs: DataFrame, file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids, slice_starts, slice_ids): the ids themselves, each slice's
    first code point and its first id, for callers that align ids with text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        coded = [encoder(file).encode([t]) for t in texts]
        empty = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), pa.array([c.ids.astype(np.int32) for c in coded], pa.list_(pa.int32())),
             pa.array([empty if c.starts is None else c.starts for c in coded], pa.list_(pa.int64())),
             pa.array([empty if c.before is None else c.before[:-1] for c in coded], pa.list_(pa.int64()))],
            [id_col, "ids", "slice_starts", "slice_ids"],
        )

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(over_texts(run), f"{id_col} {kind}, ids array<int>, slice_starts array<long>, slice_ids array<long>")
