"""Document fingerprints (9): a randomised edit embedding, sampled, banded and verified.

All texts take the same random walk: at step j, standing on a character, the
walk writes it down and moves on if the shared random bit of (j, character) is
1. Two texts that differ by few edits soon write the same characters at the
same steps again, so their edit distance shows as a Hamming distance.

A fingerprint samples the written string. Slot k reads the step whose shared
priority is least among those the walk took, from its first to its last, so
texts of nearly the same length sample the same steps, whatever that length
is, and every step is as likely as any other; the slot holds eight
bits of the character there and the one after it. Likeness is the share of
equal slots, less what chance adds. For search, bands of sampled slots give
candidates, which the likeness of whole fingerprints verifies.

Neighbours in id order: rows are dealt by range of (id, text hash, map task), so
that an id with a third of all rows is cut, and copies of one row are too; each
partition is read in order, and gives out its first and last row besides its
results. These edges, two rows a partition, meet in a join of their own.

Defined cases: a null text is empty; empty texts share the fingerprint of
zeros, like each other (1) and unlike any text with characters (0); ids are
integers, a null id comes before all others; repeated ids follow each other
in the order of their texts' hashes; a table of one row is its own next
document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, mix, partitions_for, slices, stored, text_bytes
from .graph import components

SLOTS, CLASSES, PERIOD = 128, 64, 1024
LONGEST = 1 << 36  # steps; no text's walk is as long
BANDS, BAND_SLOTS = 24, 4
#: Members of a block when a bucket is compared across components.
BLOCK = 1_000
SEED = np.uint64(0xE7037ED1A0B428DB)


@cache
def walk_table() -> list[list[int]]:
    """By class of character and step modulo PERIOD: the steps until the walk leaves the character."""
    bits = mix(np.arange(CLASSES * PERIOD, dtype=np.uint64) ^ SEED) >> np.uint64(63)
    out = []
    for row in bits.reshape(CLASSES, PERIOD).tolist():
        wait, stay = [0] * PERIOD, 0
        for j in range(2 * PERIOD - 1, -1, -1):  # twice round, so that waits cross the end
            stay = 1 if row[j % PERIOD] else stay + 1
            if j < PERIOD:
                wait[j] = stay
        out.append(wait)
    return out


@cache
def sampled_steps() -> np.ndarray:
    """``steps[:, k]``: the steps, in rising order, whose priority in slot k is less
    than that of every step before. In a walk of n steps, slot k samples the last
    of them below n, which is any of the n steps with the same chance.

    Priorities are not kept: after the j-th step held the least, no step up to
    the n-th is less with chance j / n, so the next one is drawn from that law."""
    draw = np.random.default_rng(9)
    steps = [np.zeros(SLOTS, np.int64)]
    while steps[-1].min() < LONGEST:
        after = np.minimum((steps[-1] + 1) / (1 - draw.random(SLOTS)), 2 * LONGEST)
        steps.append(after.astype(np.int64))
    return np.array(steps)


class Walk:
    """The walk of one text: its characters and the step at which it leaves each."""

    def __init__(self, text: str):
        self.text = text
        self.points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.leaves = array("q")
        self._go(self.points, 0)

    def _go(self, points: np.ndarray, step: int) -> None:
        table, put, mask = walk_table(), self.leaves.append, PERIOD - 1
        for c in (mix(points.astype(np.uint64)) & np.uint64(CLASSES - 1)).astype(np.uint8).tobytes():
            step += table[c][step & mask]
            put(step)

    def edited(self, other: str) -> Walk:
        """This text with its last quarter replaced by as much of the start of
        ``other``: the walk is the same up to there."""
        n = len(self.text)
        keep, tail = n - n // 4, other[: n // 4]
        out = object.__new__(Walk)
        out.text = self.text[:keep] + tail
        new = np.frombuffer(tail.encode("utf-32-le"), np.uint32)
        out.points, out.leaves = np.concatenate([self.points[:keep], new]), self.leaves[:keep]
        out._go(new, out.leaves[-1] if keep else 0)
        return out

    def fingerprint(self) -> np.ndarray:
        """SLOTS bytes."""
        if not len(self.points):
            return np.zeros(SLOTS, np.uint8)
        steps = sampled_steps()
        leaves = np.frombuffer(self.leaves, np.int64)
        taken = np.where(steps < leaves[-1], steps, 0).max(axis=0)
        at = np.searchsorted(leaves, taken, side="right")
        after = np.append(self.points, 0)[at + 1].astype(np.uint64)
        value = mix(self.points[at].astype(np.uint64) << np.uint64(32) | after) ^ SEED
        return (mix(value + np.arange(SLOTS, dtype=np.uint64)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots, corrected for chance: 0 to 1."""
    return max(0.0, (float((a == b).mean()) - 1 / 255) / (1 - 1 / 255))


# ------------------------------------------------------------------- Spark


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fingerprint as hex digits) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                prints = [Walk(t or "").fingerprint().tobytes().hex() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(prints, pa.string())], ["doc", "fingerprint"])

    rows = docs.select(column(id_col).alias("doc"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc {kind}, fingerprint string").withColumnRenamed("doc", id_col)


def _banded(classes: DataFrame) -> DataFrame:
    """(fingerprint, doc, bands) of classes (fingerprint, head)."""
    kind = classes.schema["head"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            prints = [np.frombuffer(bytes.fromhex(f), np.uint8) for f in batch.column("fingerprint").to_pylist()]
            bands = pa.array([band_keys(p).view(np.int64) for p in prints], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("fingerprint"), batch.column("head"), bands], ["fingerprint", "doc", "bands"])

    return classes.select("fingerprint", "head").mapInArrow(run, f"fingerprint string, doc {kind}, bands array<long>")


def band_keys(print_: np.ndarray) -> np.ndarray:
    """Hashes of BANDS samples of BAND_SLOTS slots; none for an empty text."""
    if not print_.any():
        return np.zeros(0, np.uint64)
    picked = np.random.default_rng(99).integers(0, SLOTS, (BANDS, BAND_SLOTS))
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_SLOTS):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + print_[picked[:, k]].astype(np.uint64))
    return h


def _across(rest: DataFrame, joined: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """Links (u, v) between members of a bucket (its centre left out) that are in
    different components. A bucket is cut into blocks of about BLOCK members and
    every two blocks are a group of their own, so a group is bounded."""
    kind = rest.schema["doc"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        doc, side = table.column("doc").to_pylist(), np.array(table.column("block")) != np.array(table.column("low"))
        _, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        prints = np.frombuffer(bytes.fromhex("".join(table.column("fingerprint").to_pylist())), np.uint8).reshape(len(doc), SLOTS)
        whole, links = not side.any(), []
        for i in np.flatnonzero(~side).tolist():
            others = np.arange(i + 1, len(doc)) if whole else np.flatnonzero(side)
            others = others[label[others] != label[i]]
            same = (prints[others] == prints[i]).mean(axis=1)
            for j in others[(same - 1 / 255) / (1 - 1 / 255) >= least].tolist():
                if label[i] != label[j]:
                    links.append((doc[i], doc[j]))
                    label[label == label[j]] = label[i]
        type_ = table.schema.field("doc").type
        return pa.table({"u": pa.array([x for x, _ in links], type_), "v": pa.array([x for _, x in links], type_)})

    labelled = rest.join(joined.withColumnRenamed("node", "doc"), "doc", "left")
    labelled = labelled.withColumn("label", F.coalesce("component", "doc")).drop("component")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n"))
    mixed = stored(mixed.where("a < b").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    rows = labelled.join(mixed, "key").join(heads.select("doc", "fingerprint"), "doc")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    rows = rows.select("key", "low", "high", "block", "doc", "label", "fingerprint")
    return stored(rows.groupBy("key", "low", "high").applyInArrow(compare, f"u {kind}, v {kind}"), "links-across")


def similar_documents(docs: DataFrame, *, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fingerprint, group) of every row; see ``group_similar``."""
    return group_similar(stored(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints"), least=least, id_col=id_col)


def group_similar(prints: DataFrame, *, least: float = 0.75, id_col: str = "doc_id") -> DataFrame:
    """``prints`` (read twice: a stored table with ``id_col`` and fingerprint) and the column ``group``: rows
    whose fingerprints share a band and are at least ``least`` alike are joined; ``group`` is
    the smallest id of the group, null for a null id. Equal fingerprints are one class.
    A bucket's members meet its smallest id first; those that stay in different
    components are then compared with each other, in blocks."""
    rows = prints.select(F.col(id_col).alias("doc"), "fingerprint")
    classes = stored(rows.where("doc IS NOT NULL").groupBy("fingerprint").agg(F.min("doc").alias("head")), "classes")
    heads = stored(_banded(classes), "heads")
    buckets = heads.select("doc", F.explode("bands").alias("key"))
    centres = stored(buckets.groupBy("key").agg(F.min("doc").alias("u"), F.max("doc").alias("top")).where("u < top").drop("top"), "centres")
    members = stored(buckets.join(centres, "key").where("u < doc").select("key", "u", "doc"), "members")
    pairs = members.select("u", F.col("doc").alias("v")).distinct()
    side = lambda c, p: heads.select(F.col("doc").alias(c), F.col("fingerprint").alias(p))
    same = F.expr(f"size(filter(sequence(0, {SLOTS - 1}), k -> substr(pu, 2 * k + 1, 2) = substr(pv, 2 * k + 1, 2))) / {SLOTS}")
    links = pairs.join(side("u", "pu"), "u").join(side("v", "pv"), "v").where((same - 1 / 255) / (1 - 1 / 255) >= least).select("u", "v")
    links = stored(links, "links")
    joined = components(links)
    more = _across(members.select("key", "doc"), joined, heads, least)
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    groups = classes.join(joined, F.col("head") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "head").alias("group"))
    out = prints.join(stored(groups, "groups"), "fingerprint", "left")
    return out.select(*prints.columns, F.when(F.col(id_col).isNotNull(), F.col("group")).alias("group"))


#: Bytes of text of a partition that is read in order.
RANGE_BYTES = 128 << 20
RESULT = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
#: What a partition gives out besides results: its first row and its last one.
EDGE = ["place", "edge", "text"]


def _result(doc, walk: Walk, print_: np.ndarray, text: str, next_print: np.ndarray) -> tuple:
    """The result of a document before one with ``text``."""
    changed = walk.edited(text)
    new = changed.fingerprint()
    digest = hashlib.sha256(changed.text.encode()).hexdigest()
    return (doc, len(walk.text), digest, print_.tobytes().hex(), new.tobytes().hex(), likeness(print_, new), likeness(print_, next_print))


def _kinds(kind: pa.DataType) -> list[pa.DataType]:
    return [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]


def _in_order(batches):
    """Reads a partition in order: a result for every row but the last, and two edges."""
    last = None  # (doc, walk, fingerprint) of the row before
    place, kinds = TaskContext.get().partitionId(), []
    for batch in batches:
        for part in slices(batch):
            kinds = _kinds(part.schema.field("doc").type)
            out: list[tuple] = []
            for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
                walk = Walk(text)
                print_ = walk.fingerprint()
                if last is None:
                    out.append((doc, *[None] * 6, place, "first", text))
                else:
                    out.append((*_result(*last, text, print_), None, None, None))
                last = (doc, walk, print_)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*RESULT, *EDGE])
    if last is not None:
        row = (last[0], *[None] * 6, place, "last", last[1].text)
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], [*RESULT, *EDGE])


def _at_edges(batches):
    for batch in batches:
        out = []
        for doc, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "after"))):
            walk = Walk(text)
            out.append(_result(doc, walk, walk.fingerprint(), after, Walk(after).fingerprint()))
        if out:
            kinds = _kinds(batch.schema.field("doc").type)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], RESULT)


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next): each text against itself with its last quarter
    replaced by the start of the next document, and against that document."""
    kind = docs.schema[id_col].dataType.simpleString()
    layout = f"doc {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    parts = partitions_for(docs.sparkSession, text_bytes(docs, text_col), RANGE_BYTES)
    body = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).alias("doc"), body.alias("text"), F.xxhash64(body).alias("hash"), F.spark_partition_id().alias("task"))
    order = [F.col("doc").asc_nulls_first(), "hash", "task"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc", "text")
    found = stored(dealt.mapInArrow(_in_order, f"{layout}, place int, edge string, text string"), "in-order")

    # two rows a partition: which one comes after which is settled over their numbers alone
    starts = found.where("edge = 'first'").select("place")
    after = F.coalesce(F.lead("place").over(Window.orderBy("place")), F.min("place").over(Window.partitionBy()))
    pointers = starts.select("place", after.alias("next_place"))
    firsts = found.where("edge = 'first'").select(F.col("place").alias("next_place"), F.col("text").alias("after"))
    lasts = found.where("edge = 'last'").select("place", "doc", "text")
    met = lasts.join(pointers, "place").join(firsts, "next_place").select("doc", "text", "after")
    results = found.where("edge IS NULL").select(*RESULT).unionByName(met.mapInArrow(_at_edges, layout))
    return results.withColumnRenamed("doc", id_col)
