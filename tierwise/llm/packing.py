"""Best-fit packing (8): best-fit decreasing with a segment tree over remaining capacities.

Lengths are whole numbers from 1 to the capacity, so the corpus enters the
packing as a histogram of at most ``capacity`` rows, however many documents
there are. The plan is best-fit decreasing on that histogram: a segment tree
over remaining capacities holds how many bins are open at each, and gives the
tightest one that still fits in logarithmic time. Equal lengths meet equal
bins, so a step places a whole run of pieces into a whole class of bins; it
is the same packing as placing them one by one.

Spark then numbers the pieces of each length and reads off where the plan
puts them. The numbering is a running count within (length, shard) plus the
counts of earlier shards, so a length that a third of all pieces share is
spread over all shards.

Defined cases: a null or empty text is the end id alone; a longer document
than the capacity is cut into full pieces, the first one taking the rest;
repeated rows are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encoder
from .common import over_texts, partitions_for, stored

END_ID = 0


# --------------------------------------------------------------------- plan


class OpenBins:
    """Segment tree over remaining capacities: how many bin classes are open at each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.classes: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, remaining: int, by: int) -> None:
        at = remaining + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def push(self, remaining: int, first: int, bins: int) -> None:
        if remaining and bins:
            self.classes[remaining].append((first, bins))
            self._add(remaining, 1)

    def pop_tightest(self, length: int) -> tuple[int, int, int] | None:
        """(remaining, first bin, bins) with the least remaining capacity of ``length`` or more."""
        at = length + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until something lies to the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:  # down, always to the leftmost open one
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        remaining = at - self.size
        first, bins = self.classes[remaining].pop()
        self._add(remaining, -1)
        return remaining, first, bins


@dataclass
class Plan:
    """Pieces of ``length`` numbered from ``start``: the first ``stride`` go to
    bin ``first`` one after the other from ``offset`` on, the next to the next bin."""

    length: np.ndarray
    start: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    stride: np.ndarray
    n_bins: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of the pieces with these lengths and numbers."""
        shift = np.int64(1) << 44
        at = np.searchsorted(self.length * shift + self.start, length * shift + number, side="right") - 1
        k = number - self.start[at]
        return self.first[at] + k // self.stride[at], self.offset[at] + k % self.stride[at] * length


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Plan:
    """The packing of ``histogram`` (length -> pieces). A step uses up a length
    or a class of bins, whose remaining capacity then at least halves: at most
    about 11 x 3 x capacity steps, whatever the number of pieces."""
    bins, n_bins, rows = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        done, total = 0, histogram[length]
        while done < total:
            fresh = bins.pop_tightest(length)
            if fresh is None:
                remaining, first, open_bins = capacity, n_bins, -(-(total - done) // (capacity // length))
                n_bins += open_bins
            else:
                remaining, first, open_bins = fresh
            stride = remaining // length
            placed = min(total - done, open_bins * stride)
            rows.append((length, done, first, capacity - remaining, stride))
            full, part = divmod(placed, stride)
            bins.push(remaining, first + full + (part > 0), open_bins - full - (part > 0))
            bins.push(remaining - stride * length, first, full)
            if part:
                bins.push(remaining - part * length, first + full, 1)
            done += placed
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, n_bins)


# -------------------------------------------------------------------- Spark


def token_pieces(
    docs: DataFrame, file: str, capacity: int, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32[, ids]): every document's ids and the end id, cut where too long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = encoder(file).encode([t or "" for t in batch.column("text").to_pylist()])
        end = END_ID.to_bytes(4, "little")
        row, piece, start, length, crc, kept = [], [], [], [], [], []
        for k in range(batch.num_rows):
            raw = coded.text(k).astype("<u4").tobytes() + end
            n = len(raw) // 4
            first = n - (n - 1) // capacity * capacity  # the first piece takes what is over
            for i, to in enumerate(range(first, n + 1, capacity)):
                at = max(0, to - capacity) if i else 0
                part = raw[4 * at : 4 * to]
                row.append(k)
                piece.append(i)
                start.append(at)
                length.append(to - at)
                crc.append(zlib.crc32(part))
                if with_ids:
                    kept.append(np.frombuffer(part, "<i4"))
        columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
        columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
        names = [id_col, "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(over_texts(run), schema)


def pack(pieces: DataFrame, capacity: int, *, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (a stored table with the columns piece and length) with sequence_id and offset."""
    spark = pieces.sparkSession
    n = pieces.count()
    shards = max(8, partitions_for(spark, n * 64) * 4)
    key = F.pmod(F.xxhash64(id_col, "piece"), F.lit(shards)).cast("int")
    pieces = pieces.withColumn("shard", key)

    counts = pieces.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))  # capacity x shards rows at most
    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select("length", "shard", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = best_fit_decreasing(histogram, capacity)

    within = Window.partitionBy("length", "shard").orderBy(id_col, "piece")
    rows = pieces.withColumn("within", F.row_number().over(within) - 1)
    rows = rows.join(counts.drop("n"), ["length", "shard"]).withColumn("number", F.col("before") + F.col("within"))
    columns = [c for c in pieces.columns if c != "shard"]

    def place(batches):
        for batch in batches:
            bins, offsets = plan.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins), pa.array(offsets)], [*columns, "sequence_id", "offset"])

    schema = pieces.select(*columns).schema.add("sequence_id", "long").add("offset", "long")
    return rows.select(*columns, "number").mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, file: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece of every document."""
    pieces = stored(token_pieces(docs, file, capacity, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    return pack(pieces, capacity, id_col=id_col)
