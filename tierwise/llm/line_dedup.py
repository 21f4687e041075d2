"""Line dedup (10): hashes dealt by range, first occurrences, keep bitmaps.

1. One pass over the texts writes the line table: document, position and the
   128-bit hash of the line's key (ends stripped, A-Z lower-cased). No text.
2. The line table is range-partitioned by (hash, document) and sorted by
   (hash, document, position) inside each partition. A line that a third of
   all documents share is cut by the document part of the range key, so no
   task takes it whole. A streaming aggregate over the sorted rows gives each
   document's first position of a key; a second, combined map-side, gives the
   number of documents and the very first occurrence.
3. Lines of keys in at least ``min_docs`` documents are marked in bitmaps of
   64 positions per word; zero words are left out (the compressed form).
4. Only where a caller wants text back are the bitmaps joined to the texts.

Everything is DataFrame functions: no Python runs on executors.

Defined cases: a null text is an empty text; an empty text is one empty line;
keys shorter than ``min_key_chars`` never count; rows that agree in id and
text count as one document; a null id is an id like any other; other columns
of the input are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WHITESPACE, column, stored

DOC = ["doc", "doc_hash"]
KEY = ["h1", "h2"]


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(WHITESPACE))
    ascii_only = F.octet_length(bare) == F.length(bare)  # then lower() is A-Z only, and fast
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_key_chars: int = 1) -> DataFrame:
    """(doc, doc_hash, pos, h1, h2) of every line whose key is long enough."""
    text = _text(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("doc_hash"), F.posexplode(_lines(text)).alias("pos", "line"))
    rows = rows.select(*DOC, "pos", line_key(F.col("line")).alias("key"))
    rows = rows.where(F.length("key") >= min_key_chars)
    return rows.select(*DOC, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, first) of the keys found in ``min_docs`` documents or more;
    ``first`` is the first occurrence by (doc, doc_hash, position)."""
    dealt = lines.repartitionByRange(*KEY, *DOC).sortWithinPartitions(*KEY, *DOC, "pos")
    in_doc = dealt.groupBy(*KEY, *DOC).agg(F.min("pos").alias("pos"))
    counted = in_doc.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(*DOC, "pos")).alias("first"))
    return counted.where(F.col("n_docs") >= min_docs)


def drop_bitmaps(lines: DataFrame, *, min_docs: int, keep: str = "none") -> DataFrame:
    """(doc, doc_hash, words): per document with dropped lines the non-zero
    64-bit words of its bitmap, word number -> bits. ``keep="none"`` drops
    every line of a frequent key; ``"first"`` keeps its first occurrence."""
    if keep not in ("none", "first"):
        raise ValueError("keep must be 'none' or 'first'")
    # stored, so that both sides of the join are shuffled and adaptive execution can split a hot line
    hit = lines.join(stored(frequent_lines(lines, min_docs), "frequent-lines"), KEY)
    if keep == "first":
        hit = hit.where(~F.struct(*DOC, "pos").eqNullSafe(F.col("first")))
    word = hit.groupBy(*DOC, F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    # one entry for 64 lines: bounded by the document's own length
    return word.groupBy(*DOC).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _marked(docs: DataFrame, carry: list[str], min_docs: int, keep: str, min_key_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, carried, body, drop_words, kept_text) of every row; ``carried`` holds the columns ``carry``."""
    lines = stored(line_table(docs, id_col=id_col, text_col=text_col, min_key_chars=min_key_chars), "lines")
    maps = drop_bitmaps(lines, min_docs=min_docs, keep=keep)
    maps = maps.select(F.col("doc").alias("m_doc"), F.col("doc_hash").alias("m_hash"), F.col("words").alias("drop_words"))
    carried = F.struct(*(column(c) for c in carry)) if carry else F.lit(None)
    rows = docs.select(F.col(id_col).alias("doc"), carried.alias("carried"), _text(text_col).alias("body"))
    rows = rows.withColumn("doc_hash", F.xxhash64("body"))
    rows = rows.join(maps, F.col("doc").eqNullSafe(F.col("m_doc")) & (F.col("doc_hash") == F.col("m_hash")), "left")
    rows = rows.withColumn(
        "dense", F.expr("transform(sequence(0, array_max(map_keys(drop_words))), w -> coalesce(drop_words[w], 0L))")
    )
    kept = F.expr(
        r"""array_join(filter(split(body, '\n', -1),
            (x, i) -> i div 64 >= size(dense) or (shiftright(dense[cast(i div 64 as int)], i % 64) & 1L) = 0), '\n')"""
    )
    kept = F.when(F.col("drop_words").isNull(), F.col("body")).otherwise(kept)
    return rows.select("doc", "carried", "body", "drop_words", kept.alias("kept_text"))


def dedup_lines(
    docs: DataFrame, *, min_docs: int = 10, keep: str = "none", min_key_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``id_col``, n_lines, n_dropped, drop_words
    (the compressed bitmap, null if nothing is dropped) and kept_text."""
    rows = _marked(docs, [], min_docs, keep, min_key_chars, id_col, text_col)
    return rows.select(
        F.col("doc").alias(id_col),
        F.size(_lines(F.col("body"))).cast("long").alias("n_lines"),
        F.coalesce(F.expr("aggregate(map_values(drop_words), 0L, (a, x) -> a + bit_count(x))"), F.lit(0)).cast("long").alias("n_dropped"),
        "drop_words",
        "kept_text",
    )


def drop_repeated_lines(
    docs: DataFrame, *, min_docs: int = 10, keep: str = "none", min_key_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the text of every row without its dropped lines; other columns as they are."""
    others = [c for c in docs.columns if c != text_col]
    rows = _marked(docs, others, min_docs, keep, min_key_chars, id_col, text_col)
    return rows.select(*((F.col("kept_text") if c == text_col else F.col("carried")[c]).alias(c) for c in docs.columns))
