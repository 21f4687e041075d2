"""What the operators of this subpackage share: tables, folders, text as arrays.

Text work that Spark's own functions cannot express runs on Arrow batches:
a batch's texts are one byte buffer with offsets, words are found and hashed
by array operations over that buffer, never by a Python loop per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at a time (a longer single text is taken whole).
SLICE_BYTES = 1 << 20
WHITESPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: list[str] = []


# ------------------------------------------------------------------ tables


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share
    (``spark.checkpoint.dir``; a scratch folder only where it is unset and all
    runs in one process, as in local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="tierwise-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and a
    lost executor costs a read instead of the whole lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts (one pass over the column's lengths)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]


def partitions_for(spark: SparkSession, n_bytes: int, per_task: int = 16 << 20) -> int:
    """Tasks for ``n_bytes`` of data, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per_task))


# ------------------------------------------------------------ texts as bytes


def slices(batch: pa.RecordBatch, text_col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows of about ``limit`` bytes of text."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(np.diff(string_bytes(batch.column(text_col))[1]))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


#: Bytes that part words where the contract says ``[^\x20\x09-\x0D]+``.
IS_SPACE = _byte_set(WHITESPACE)
#: Bytes that part words made of letters only: all of ASCII but its letters.
IS_NO_LETTER = np.arange(256) < 128
IS_NO_LETTER[list((UPPER + LOWER).encode())] = False
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[list(UPPER.encode())] = list(LOWER.encode())


def word_spans(buf: np.ndarray, offsets: np.ndarray, parting: np.ndarray = IS_SPACE):
    """(start, end, doc) of every word: a run of bytes outside ``parting``, within one text."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~parting[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


# ---------------------------------------------------------------- hash values

_R = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _powers[k] = np.cumprod(t)
    return _powers


class SpanHash:
    """64-bit hashes of any byte spans of a buffer: one running sum, then two
    lookups per span. Equal spans hash alike in every batch and process."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _power_tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * up[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Bytes that ``span_hashes`` takes at a time.
HASH_BYTES = 1 << 22


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``SpanHash(buf)(start, end)`` of spans in order, block by block: a long text or
    span costs memory for its spans and one block, not for every byte."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = int(np.searchsorted(end, low + HASH_BYTES, side="right"))
        if to > at:
            out[at:to] = SpanHash(buf[low : int(end[to - 1])])(start[at:to] - low, end[at:to] - low)
        else:
            to, whole = at + 1, buf[low : int(end[at])]
            parts = [int(SpanHash(whole[o : o + HASH_BYTES]).sums[-1]) * pow(_R, o, 1 << 64) for o in range(0, len(whole), HASH_BYTES)]
            out[at] = mix(np.array([(sum(parts) + len(whole) * 0xD6E8FEB86659FD93) % (1 << 64)], np.uint64))[0]
        at = to
    return out


def window_hashes(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of every window of ``size`` words that lies in one document."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9FB21C651E98DF25) + (words[k : k + n] ^ (words[k : k + n] >> np.uint64(29)))
    whole = doc[:n] == doc[size - 1 :]
    return mix(h[whole]), doc[:n][whole]


def over_texts(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], text_col: str = "text", limit: int = SLICE_BYTES):
    """A ``mapInArrow`` function that applies ``f`` to slices of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, limit):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def keep_texts(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], text_col: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text ``keep`` marks; all columns as they are, whatever their names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    rows = docs.toDF(*names)
    kept = rows.mapInArrow(over_texts(lambda batch: batch.filter(pa.array(keep(batch.column(text)))), text, limit), rows.schema)
    return kept.toDF(*docs.columns)
