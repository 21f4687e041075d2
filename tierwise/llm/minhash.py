"""MinHash near-dedup (6): b-bit signatures, band candidates, exact confirmation.

1. One pass sketches every text: the size and a 128-bit hash of its shingle
   set, ``MINIMA`` minima folded into one key per band, and the low
   ``BITS`` bits of each minimum packed into words.
2. Equal sets form a class, and its smallest id stands for it: thousands of
   copies enter the search once.
3. Texts that share a band key are candidates. A bucket is a star: its members
   are compared with its smallest id only, never all with all. Candidates whose
   similarity estimated from bit counts (corrected for chance agreement) is
   clearly too low go; the rest are confirmed on their full sets.
4. Where a bucket's members still belong to several components, they are
   compared across components: by the estimate first, then by their full sets.
   Only links that join components come out. So no link is lost to the stars,
   and a bucket whose members have met costs nothing. A bucket of up to
   ``BLOCK`` members is compared in one go, which keeps the work in proportion
   to the members. Members of larger ones (a passage that many texts share, none
   of them alike) are first dealt anew by their rarest shingles, so many that
   two texts at the threshold share one; what a passage has in common comes last
   and parts them no more. Buckets that stay large even so hold texts just
   below the threshold; their blocks are compared two by two.
5. Components of the links, each named by its smallest id.

At similarity 0.75 a pair shares none of 32 bands of 4 rows with a chance of
5e-6, and is dropped by the estimate with one of 2e-8. Lower thresholds have
more bands of fewer rows; those below 9 percent are refused.

Defined cases: a text without words (or null) has an empty set and no links;
one with fewer words than a shingle has its whole sequence as its only one;
rows with a null id are kept and not linked; repeated rows share their
component; where one id stands on different texts, the links of any of them are
that id's, so give such rows ids of their own, as ``drop_near_duplicates`` does;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, SpanHash, column, mix, over_texts, stored, string_bytes, window_hashes, word_spans
from .graph import components

WORDS, MINIMA, BITS = 5, 128, 4
#: Chance with which a pair at the threshold may share no band.
MISS = 1e-5


def band_rows(percent: int) -> int:
    """Minima of a band: the most, of 4, 2 and 1, with which a pair at the threshold
    is missed by all bands with a chance of MISS or less."""
    for rows in (4, 2, 1):
        if (1 - (percent / 100) ** rows) ** (MINIMA // rows) <= MISS:
            return rows
    raise ValueError(f"{MINIMA} minima do not find pairs of a similarity of {percent} percent")


def least_estimate(percent: int) -> float:
    """The least estimate that does not rule a pair out: 5.5 standard errors below the threshold."""
    similarity = percent / 100
    p = similarity + (1 - similarity) / 2**BITS
    return similarity - 5.5 * float(np.sqrt(p * (1 - p) / MINIMA)) / (1 - 2.0**-BITS)


#: Members of a bucket that are compared in one go, and of a block of a larger one.
BLOCK = 1_000
_FACTORS = np.random.default_rng(6).integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each text, sorted; text k has
    ``hashes[first[k]:first[k + 1]]``."""
    buf, offsets = string_bytes(texts)
    buf = ASCII_LOWER[buf]
    start, end, doc = word_spans(buf, offsets)
    words = SpanHash(buf)(start, end)
    found, owner = window_hashes(words, doc, size)
    n = len(texts)
    per_doc = np.bincount(doc, minlength=n)
    short = np.flatnonzero((per_doc > 0) & (per_doc < size))
    if len(short):  # the whole sequence, hashed with its length
        at = np.concatenate([[0], np.cumsum(per_doc)])[short]
        whole = per_doc[short].astype(np.uint64)
        for k in range(size - 1):
            held = per_doc[short] > k
            whole[held] = mix(whole[held] * np.uint64(0x9FB21C651E98DF25) + words[at[held] + k])
        place = np.searchsorted(owner, short)
        found, owner = np.insert(found, place, whole), np.insert(owner, place, short)
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])


def _sketch(batch: pa.RecordBatch, rows: int) -> pa.RecordBatch:
    found, first = shingle_sets(batch.column("text"))
    n = np.diff(first)
    some = np.flatnonzero(n)
    minima = np.zeros((batch.num_rows, MINIMA), np.uint64)
    sums = np.zeros((batch.num_rows, 2), np.uint64)
    if len(some):
        at = first[some]
        for k, factor in enumerate(_FACTORS):
            minima[some, k] = np.minimum.reduceat(found * factor, at)
        sums[some, 0] = np.add.reduceat(mix(found), at)
        sums[some, 1] = np.add.reduceat(mix(found ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
    bands = MINIMA // rows
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (batch.num_rows, bands)).copy()
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + minima[:, k::rows])
    low = (mix(minima) & np.uint64(2**BITS - 1)).reshape(batch.num_rows, -1, 64 // BITS)
    packed = np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)
    lists = lambda x: pa.ListArray.from_arrays(
        pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().view(np.int64))
    )
    return pa.RecordBatch.from_arrays(
        [batch.column("doc"), pa.array(n), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), lists(keys), lists(packed)],
        ["doc", "n_shingles", "s1", "s2", "bands", "signature"],
    )


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    found, first = shingle_sets(batch.column("text"))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found.view(np.int64)))], ["doc", "shingles"]
    )


def estimate(a: Column, b: Column) -> Column:
    """The similarity that two packed signatures show, less what chance agreement adds."""
    differs = F.lit(0)
    for k in range(MINIMA * BITS // 64):
        x = a[k].bitwiseXOR(b[k])
        for step in (1, 2):  # a field that differs anywhere shows in its lowest bit
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differs = differs + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return ((F.lit(MINIMA) - differs) / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS)


def _likely(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose estimate doesn't rule them out."""
    sig = lambda c, s: signatures.select(F.col("doc").alias(c), F.col("signature").alias(s))
    pairs = pairs.join(sig("u", "su"), "u").join(sig("v", "sv"), "v")
    return pairs.where(estimate(F.col("su"), F.col("sv")) >= least_estimate(percent)).select("u", "v")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that the full sets confirm."""
    pairs = stored(pairs, "candidates")
    held = lambda c, s: sets.select(F.col("doc").alias(c), F.col("shingles").alias(s))
    both = pairs.join(held("u", "a"), "u").join(held("v", "b"), "v")
    common = F.size(F.array_intersect("a", "b"))
    return stored(both.where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("u", "v"), "confirmed")


def _star_pairs(buckets: DataFrame) -> DataFrame:
    """(key, band, u, v): every member of a bucket of at least two with the bucket's smallest id."""
    centre = stored(buckets.groupBy("key").agg(F.min("doc").alias("u"), F.max("doc").alias("top")).where("u < top").drop("top"), "centres")
    return buckets.join(centre, "key").select("key", "band", "u", F.col("doc").alias("v"))


def _compare(doc, label, side, band: int, bands, signature, shingles: pa.ListArray, percent: int) -> list[tuple[int, int]]:
    """Links (u, v) that join components, among the members of one block pair of
    one bucket. ``side`` is the block of a member: 0 or 1, all 0 within a block."""
    sizes = shingles.value_lengths().to_numpy()
    _, ids = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    whole = side.max() == 0
    links = []
    for i in np.flatnonzero(side == 0).tolist():
        rest = np.arange(i + 1, len(doc)) if whole else np.flatnonzero(side == 1)
        rest = rest[label[rest] != label[i]]
        x = signature[rest] ^ signature[i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differs = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1)
        likely = ((MINIMA - differs) / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS) >= least_estimate(percent)
        rest = rest[likely & ~(bands[rest, :band] == bands[i, :band]).any(axis=1)]  # else met in an earlier bucket
        if not len(rest):
            continue
        held = np.zeros(len(ids), bool)
        held[ids[starts[i] : starts[i] + sizes[i]]] = True
        common = np.add.reduceat(held[ids], starts, dtype=np.int64)[rest]
        for j in rest[100 * common >= percent * (sizes[i] + sizes[rest] - common)].tolist():
            if label[i] != label[j]:
                links.append((doc[i], doc[j]))
                label[label == label[j]] = label[i]
    return links


def _compare_blocks(percent: int):
    """Reads rows sorted by block pair and compares each block pair's members."""

    def links_of(table: pa.Table) -> list[tuple[int, int]]:
        col = lambda c: table.column(c).combine_chunks()
        matrix = lambda c: col(c).flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
        codes: dict = {}  # labels are ids: numbers, texts or structs
        label = np.array([codes.setdefault(str(x), len(codes)) for x in col("label").to_pylist()])
        side = (col("block").to_numpy() != col("low").to_numpy()).astype(np.int8)
        doc = col("doc").to_pylist()
        return _compare(doc, label, side, int(col("band")[0].as_py()), matrix("bands"), matrix("signature"), col("shingles"), percent)

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the block pair that the last batch ended in
        now = None

        def settle(out):
            if held:
                out += links_of(pa.Table.from_batches(held))
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple[int, int]] = []
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")])
            cuts = [0, *(1 + np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if now != (here := tuple(key[:, a].tolist())):
                    settle(out)
                    now = here
                held.append(batch.slice(a, b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field("doc").type) for x in zip(*out)], ["u", "v"])
        out = []
        kind = held[0].schema.field("doc").type if held else None
        settle(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*out)], ["u", "v"])

    return run


def _unsettled(rest: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the members of buckets with their component as ``label``; key and n of the
    buckets whose members, centre left out, are in several components)."""
    labelled = rest.join(joined.withColumnRenamed("node", "doc"), "doc", "left")
    labelled = labelled.withColumn("label", F.coalesce("component", "doc")).drop("component")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n"))
    return labelled, stored(mixed.where("a < b").select("key", "n"), "mixed")


def _across(labelled: DataFrame, mixed: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of the buckets ``mixed`` that are in different
    components. A bucket is cut into blocks of about BLOCK members and every two
    blocks are compared in a task of their own, so a task's rows are bounded
    whatever the bucket's size; only links come out."""
    mixed = mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = labelled.join(mixed, "key").join(heads.select("doc", "bands", "signature"), "doc").join(sets, "doc")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    pair = ["key", "low", "high"]
    rows = rows.select(*pair, "block", "band", "doc", "label", "bands", "signature", "shingles")
    rows = rows.repartition(*pair).sortWithinPartitions(*pair)
    kind = labelled.schema["doc"].dataType.simpleString()
    return stored(rows.mapInArrow(_compare_blocks(percent), f"u {kind}, v {kind}"), "confirmed-across")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, band, doc): the rarest shingles of each set, so many that two sets as alike
    as ``percent`` share one of them at least. Rarity is counted over ``sets``, so a
    passage that all of them hold comes last; shingles of one set alone meet nothing."""
    each = sets.select("doc", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = each.join(stored(common, "common-shingles"), "shingle")
    # one entry for each of its shingles: bounded by the document's own length
    of_doc = shared.groupBy("doc", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    length = F.expr(f"size - ({percent} * size + 99) div 100 + 1 - (size - size(held))").cast("int")
    keys = of_doc.select("doc", F.explode(F.slice("held", F.lit(1), F.greatest(length, F.lit(0)))).alias("at"))
    return stored(keys.select(F.col("at.shingle").alias("key"), F.lit(0).alias("band"), "doc"), "prefixes")


def _links_of_hot(
    hot: DataFrame, labelled: DataFrame, links: DataFrame, heads: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """Links (u, v) that join components among all members of the buckets ``hot``: the
    members are dealt anew by their rarest shingles, which loses no link. The buckets
    made so go the way of all others: stars, then what is left across components."""
    members = stored(labelled.join(hot, "key", "left_semi").select("doc").distinct(), "hot-members")
    stars = stored(_star_pairs(_prefixes(sets.join(members, "doc", "left_semi"), percent)), "hot-buckets").where("u <> v")
    found = _confirm(_likely(stars.select("u", "v").distinct(), heads.select("doc", "signature"), percent), sets, percent)
    joined = components(links.unionByName(found))
    return found.unionByName(_across(*_unsettled(stars.select("key", "band", F.col("v").alias("doc")), joined), heads, sets, percent))


def near_duplicates(docs: DataFrame, *, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_shingles, component_id, kept) of every row; rows are linked
    where ``100 * |A & B| >= percent * |A | B|``."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    layout = f"doc {kind}, n_shingles long, s1 long, s2 long, bands array<long>, signature array<long>"
    in_band = band_rows(percent)
    rows = stored(texts.mapInArrow(over_texts(lambda batch: _sketch(batch, in_band)), layout), "sketches")

    searched = rows.where(F.col("doc").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(searched.groupBy("s1", "s2", "n_shingles").agg(F.min("doc").alias("head")), "classes")
    heads = searched.join(classes.select(F.col("head").alias("doc"), "s1", "s2"), ["doc", "s1", "s2"], "left_semi")
    signatures = heads.select("doc", "signature")

    buckets = heads.select("doc", F.posexplode("bands").alias("band", "key"))
    stars = stored(_star_pairs(buckets), "buckets")  # members of buckets with at least two
    members = stars.select(F.col("v").alias("doc")).distinct()
    sets = stored(texts.join(members, "doc", "left_semi").mapInArrow(over_texts(_sets), f"doc {kind}, shingles array<long>"), "sets")

    apart = stars.where("u <> v")
    links = _confirm(_likely(apart.select("u", "v").distinct(), signatures, percent), sets, percent)
    joined = components(links)
    labelled, mixed = _unsettled(apart.select("key", "band", F.col("v").alias("doc")), joined)
    more = _across(labelled, mixed.where(F.col("n") <= BLOCK), heads, sets, percent)
    hot = mixed.where(F.col("n") > BLOCK)
    if not hot.isEmpty():
        more = more.unionByName(_links_of_hot(hot, labelled, links.unionByName(more), heads, sets, percent))
    if not more.isEmpty():
        joined = components(links.unionByName(more))

    heads_of = classes.join(joined, F.col("head") == F.col("node"), "left")
    heads_of = stored(heads_of.select("s1", "s2", "n_shingles", F.coalesce("component", "head").alias("component_id")), "class-components")
    out = rows.select("doc", "s1", "s2", "n_shingles").join(heads_of, ["s1", "s2", "n_shingles"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc").isNotNull(), F.col("component_id")).otherwise(F.col("doc"))
    return out.select(
        F.col("doc").alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc") == own, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, *, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, with one row of each group of near
    duplicates: the one with the smallest id (null first), then text hash.

    A row's identity is its id and its text, so an id that stands on different
    texts loses only those that are like another row, and of rows that agree in
    both one stays (the one whose other columns hash lowest). Rows without words
    are like nothing else, but equal ones with one id are one row."""
    body = F.coalesce(column(text_col), F.lit(""))
    node = F.struct(column(id_col).alias("id"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2"))
    carried = F.struct(*(column(c).alias(c) for c in docs.columns))
    rows = docs.select(node.alias("node"), carried.alias("carried"))

    found = near_duplicates(docs.select(node.alias("node"), column(text_col).alias("text")), percent=percent, id_col="node")
    marked = found.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("stays")).where("n > 1 OR NOT stays")
    marked = stored(marked, "marked")  # both sides of the joins are shuffled then, so that a hot row can be split
    single = rows.join(marked, "node", "left_anti")
    repeated = rows.join(marked.where("stays"), "node", "left_semi")  # reduced before it is shuffled by its key
    plain = [c for c in docs.columns if "map<" not in (kind := docs.schema[c].dataType.simpleString()) and "variant" not in kind]
    order = F.xxhash64(*(F.col("carried")[c] for c in plain))
    repeated = repeated.groupBy("node").agg(F.min_by("carried", order).alias("carried"))
    return single.unionByName(repeated).select(*(F.col("carried")[c].alias(c) for c in docs.columns))
