"""Token counts (2): a digest cache of counts, filled by distinct misses only.

A cache table holds (digest, tokenizer, n_tokens). ``digest`` is the SHA-256
of the normalised content (null becomes empty; the bytes are otherwise left
alone, since any other change could change the count) and ``tokenizer`` the
SHA-256 of the tokenizer's file, so a new version never meets old counts.

A run joins the digests of all rows to the cache; those that miss are stored and
marked in a bitmap of ``MARKS`` bits, whose words are broadcast. Rows whose bit is
not set are known and go no further, so with a full cache no text is shuffled. Of
the others one text for each digest is kept, before the shuffle and after it
(thousands of copies of one text, with whatever ids, leave one in each task), rows
that hit a bit by chance go by an exact join, and just those texts are encoded and
their counts appended. Then every row reads its count from the cache, by digest.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows
and ids give a row each; other columns are never read; an empty table gives
an empty result and an unchanged cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, slices, stored

#: Bits of the map of missing digests: at most MARKS / 64 rows are broadcast.
MARKS = 1 << 25
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


class TokenCache:
    """The counts kept at ``path`` (any path that Spark writes to)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(path)

    def counts(self, version: str) -> DataFrame:
        """(digest, n_tokens), once per digest: two runs may have added the same."""
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).where(F.col("tokenizer") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(self.path)


def tokenizer_version(file: str) -> str:
    with open(file, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(file: str):
    """texts -> token counts, by the library that the file belongs to."""
    if file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(file)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def _encode(file: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            for part in slices(batch, "body"):
                count = count or _counter(file)
                n = pa.array(count(part.column("body").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("digest"), n], ["digest", "n_tokens"])

    return run


def _texts_of(rows: DataFrame, missing: DataFrame) -> DataFrame:
    """(digest, body), once for each digest of ``missing``."""
    place = F.pmod(F.xxhash64("digest"), F.lit(MARKS))
    word, bit = (place / 64).cast("long"), F.pmod(place, F.lit(64)).cast("int")
    marks = missing.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mark"))
    marks = marks.groupBy("word").agg(F.bit_or("mark").alias("marks"))
    likely = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(marks), "word")
    likely = likely.where(F.expr("getbit(marks, bit) = 1")).select("digest", "body")
    return likely.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")


def count_tokens(docs: DataFrame, cache: TokenCache, file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_bytes, n_tokens) of every row; missing counts are added to ``cache``."""
    version = tokenizer_version(file)
    body = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).alias("doc"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("digest"))

    known = cache.counts(version).select("digest")
    missing = stored(rows.select("digest").distinct().join(known, "digest", "left_anti"), "missing")
    texts = _texts_of(rows.select("digest", "body"), missing)
    cache.append(texts.mapInArrow(_encode(file), "digest binary, n_tokens long"), version)

    # copies of one text share a digest: with the counts stored, both sides of
    # this join are shuffled, and adaptive execution splits such a group
    lean = rows.select("doc", "digest", F.octet_length("body").cast("long").alias("n_bytes"))
    return lean.join(stored(cache.counts(version), "counts"), "digest").select(F.col("doc").alias(id_col), "n_bytes", "n_tokens")
