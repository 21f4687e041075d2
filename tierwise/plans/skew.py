"""Hot-key aware join of row-level data to a per-key summary.

Several operators end with "give every input row its entity's result": a join
of the full rows (huge, possibly one entity holding a third of them) to a
summary with one row per entity. A plain shuffle join sends every row of a key
to one task, so one hot entity would become one enormous task.

:func:`split_join` splits hot keys instead:

1. Rows are counted per key: by the summary itself, where it has a count
   column (then its shuffle is read again, not the input), else by an
   aggregate over the key columns. A key is hot when it has at least
   ``piece_rows`` rows, whatever the session's partition settings; by default
   that is ``PIECE_BYTES`` divided by the schema's row width. Only when the
   input is so large that more than ``MAX_HOT`` keys could qualify does the
   limit rise, to ``N / MAX_HOT`` rows of the total ``N``. So the hot-key table
   has at most ``MAX_HOT`` rows, a proven bound, and is broadcast; a key below
   the limit is a normal task, or less than a ``MAX_HOT``-th of the input.
2. A hot key is cut into ``ceil(n / limit)`` pieces. Its rows get piece
   ``hash(map task index, values) mod k`` (see :func:`row_spread`:
   deterministic under task retries, and copies of one row spread over map
   tasks); its summary row is repeated once per piece. Cold keys have one
   piece, number 0.
3. The join runs on (key, piece), so a hot key's rows spread over ``k`` tasks.

Rows whose key is NULL in a plain (not null-safe) join can match nothing; they
are spread over the session's shuffle partitions so that a NULL-heavy input
does not pile up either.

The piece of a row depends on its map task, so Spark does not move a filter
from behind the join to the scan. Filter an operator's *input* by entity
instead: the result is the same, and that filter reaches every scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spec import RESERVED_PREFIX

PIECE = RESERVED_PREFIX + "piece"
PIECES = RESERVED_PREFIX + "pieces"
SPIECE = RESERVED_PREFIX + "spiece"

#: Bytes of a piece, by the row width that the schema suggests (a text counts as WIDE bytes).
PIECE_BYTES, WIDE = 128 << 20, 64
#: Rows of the broadcast table of hot keys, at most.
MAX_HOT = 100_000


def row_width(df: DataFrame) -> int:
    """Bytes of a row as the schema suggests: fixed widths, WIDE for what varies."""
    fixed = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.DateType: 4, T.FloatType: 4}
    wide = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    return sum(WIDE if isinstance(f.dataType, wide) else fixed.get(type(f.dataType), 8) for f in df.schema.fields)


#: Bytes of a row in memory for a byte in the files that it is read from.
EXPANSION = 3


def source_bytes(df: DataFrame) -> int | None:
    """What Spark's plan knows of the size of the columns of ``df`` that are read, from
    the files' sizes (no job runs); None where it knows nothing."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known * EXPANSION if known < 1 << 60 else None


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    try:
        value = df.sparkSession.conf.get(key, None)
    except Exception:  # pragma: no cover - conf access is best effort
        value = None
    return int(value) if value else default


def _unpruned(summary: DataFrame, count_col: str) -> DataFrame:
    """``summary`` with a condition that is always true but names every column,
    so that all its uses need the same aggregates and share one shuffle."""
    hashable = [F.col(f.name) for f in summary.schema.fields if _hashable(f.dataType)]
    return summary.where((F.hash(*hashable) >= F.lit(-(1 << 31))) & (F.col(count_col) > 0))


def hot_keys(
    rows: DataFrame,
    keys: list[str],
    *,
    pieces: int | None = None,
    min_rows: int = 0,
    null_safe: bool,
    piece_rows: int | None = None,
    counts: DataFrame | None = None,
    count_col: str | None = None,
) -> DataFrame:
    """Keys with at least ``piece_rows`` rows (``N / pieces`` if that is given and
    less; never fewer than ``N / MAX_HOT`` or ``min_rows``), with the number of
    pieces to cut each into. At most ``MAX_HOT`` keys qualify.

    By default computed from the rows' key columns alone (a count per key,
    combined map-side), so the scan reads only those columns. A per-key
    ``counts`` table with the row count in ``count_col`` can be given instead.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(RESERVED_PREFIX + "cnt"))
    else:
        counts = counts.select(*keys, F.col(count_col).alias(RESERVED_PREFIX + "cnt"))
    n = F.col(RESERVED_PREFIX + "cnt")
    # the total is summed from the per-key counts, so one shuffle serves both
    total = counts.select(F.sum(n)).scalar()
    size = F.lit(float(piece_rows if piece_rows is not None else max(1, PIECE_BYTES // row_width(rows))))
    if piece_rows is None and (known := source_bytes(rows)):
        # rows wider than the schema suggests (long texts): their mean width, total bytes by total rows
        size = F.greatest(F.lit(1.0), F.least(size, F.lit(float(PIECE_BYTES)) * total / F.lit(float(known))))
    if pieces:
        size = F.least(size, total / F.lit(pieces))
    size = F.greatest(size, total / F.lit(MAX_HOT))
    hot = counts.where((n >= size) & (n >= F.lit(min_rows)))
    if not null_safe:  # NULL keys match nothing; they are spread separately
        hot = hot.where(_all([F.col(k).isNotNull() for k in keys]))
    return hot.select(*keys, F.ceil(n / size).cast("int").alias(PIECES))


def split_join(
    rows: DataFrame,
    summary: DataFrame,
    keys: list[str],
    *,
    how: str = "left",
    null_safe: bool = False,
    pieces: int | None = None,
    min_rows: int | None = None,
    piece_rows: int | None = None,
    count_col: str | None = None,
    key_counts: DataFrame | None = None,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """``rows JOIN summary USING (keys)`` with hot keys split across tasks.

    ``summary`` must hold at most one row per key. Output columns: all of
    ``rows``, then the summary's non-key columns (except ``count_col``).
    ``how`` is ``"left"`` or ``"inner"``. With ``null_safe`` NULL keys match
    each other (the key groups of ``groupBy``); otherwise they match nothing.

    Hot keys come from per-key row counts: by default a count over the rows'
    key columns (a cheap hash aggregation reading only those columns); with
    ``count_col``, the summary's own column (one shuffle then serves the
    counts and the join); or ``key_counts`` (keys + ``count_col``). Counts may
    overestimate the rows per key (more pieces, still bounded).

    ``spread_by`` names the columns whose values, with the map task, spread a
    hot key's rows; name those that the caller reads anyway, so that no other
    column is read for it (default: all).
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    null_pieces = pieces or _conf_int(rows, "spark.sql.shuffle.partitions", 200)
    if min_rows is None:
        min_rows = _conf_int(rows, "tierwise.skew.minRows", 0)
    if piece_rows is None:
        piece_rows = _conf_int(rows, "tierwise.skew.pieceRows", 0) or None
    pieces = pieces or _conf_int(rows, "tierwise.skew.pieces", 0) or None
    if key_counts is None and count_col:
        if not null_safe:  # what matches nothing is left out of all uses alike
            summary = summary.where(_all([F.col(k).isNotNull() for k in keys]))
        summary = _unpruned(summary, count_col)
    # MAX_HOT keys at most: the broadcast side is bounded.
    hot = F.broadcast(
        hot_keys(
            rows, keys, pieces=pieces, min_rows=min_rows, null_safe=null_safe, piece_rows=piece_rows,
            counts=key_counts if key_counts is not None else (summary if count_col else None),
            count_col=count_col,
        )
    )

    def eq(lname: str, rname: str) -> Column:
        a, b = F.col(lname), F.col(rname)
        return a.eqNullSafe(b) if null_safe else a == b

    renamed = {k: RESERVED_PREFIX + "sk_" + k for k in keys}
    hot_r = hot.select(*[F.col(k).alias(renamed[k]) for k in keys], PIECES)
    hot_on = lambda: _all([eq(k, renamed[k]) for k in keys])

    # Row side: look up the piece count of hot keys (map-side broadcast join).
    tagged = rows.join(hot_r, on=hot_on(), how="left").drop(*renamed.values())
    spread = row_spread(rows, spread_by)
    piece = F.when(F.col(PIECES).isNotNull(), F.pmod(spread, F.col(PIECES))).otherwise(F.lit(0))
    if not null_safe:
        any_null = _any([F.col(k).isNull() for k in keys])
        piece = F.when(any_null, F.pmod(spread, F.lit(null_pieces))).otherwise(piece)
    tagged = tagged.withColumn(PIECE, piece.cast("int")).drop(PIECES)

    # Summary side: one copy per piece of a hot key, one row for a cold key.
    extra = [c for c in summary.columns if c not in keys and c != count_col]
    check_new(rows, extra)
    s = summary.join(hot_r, on=hot_on(), how="left")
    s = s.select(
        *[F.col(k).alias(renamed[k]) for k in keys],
        *extra,
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col(PIECES), F.lit(1)) - 1)).alias(SPIECE),
    )
    # Both sides may derive from one input: join through aliases, select by name.
    cond = _all([eq(k, renamed[k]) for k in keys] + [F.col(PIECE) == F.col(SPIECE)])
    out = tagged.alias("__tw_l").join(s.alias("__tw_r"), on=cond, how=how)
    return out.select(*rows.columns, *extra)


def check_new(df: DataFrame, names: list[str]) -> None:
    """Result columns must not carry the name of an input column (names are compared as the session does)."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    fold = (lambda c: c) if sensitive else str.lower
    held = {fold(c) for c in df.columns}
    clash = [c for c in names if fold(c) in held]
    if clash:
        raise ValueError(f"result columns {clash} already exist in the input")


def row_spread(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """A piece source that survives task retries: the hash of the map task's
    partition index and the row's values in ``columns`` (default: all).

    It does not depend on row order (a retried task, even one reading shuffle
    output in another order, puts every row in the same piece again), distinct
    rows of one task spread over the pieces, and rows with equal values spread
    over the map tasks that hold them (a map task's input is bounded by the
    split size). Only rows of hot keys (and NULL keys of plain joins) evaluate it.
    """
    fields = [f for f in rows.schema.fields if columns is None or f.name in columns]
    return F.xxhash64(F.spark_partition_id(), *[F.col(f.name) for f in fields if _hashable(f.dataType)])


def _hashable(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType) or type(dt).__name__ == "VariantType":
        return False
    if isinstance(dt, T.StructType):
        return all(_hashable(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return _hashable(dt.elementType)
    return True


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out
