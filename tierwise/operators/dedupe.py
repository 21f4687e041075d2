"""Deterministic one-record-per-entity selection (for example GP same-day repeats)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import canonical, orderable
from ..plans.spec import RESERVED_PREFIX, ColumnSpec

P = RESERVED_PREFIX


def dedupe(
    df: DataFrame,
    spec: ColumnSpec,
    *,
    priority: tuple[str, list] | None = None,
    order: list[str] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Keep one record per ``keys`` (default: the entity).

    The record kept is the first by: position of ``priority[0]``'s value in the
    list ``priority[1]`` (values not listed come after all listed ones), then
    the ``order`` columns ascending, then every other orderable column
    ascending, then the canonical forms of columns without an order (maps); so the
    choice never depends on row order or partitioning.
    Built as ``groupBy(keys).agg(min(struct(ordering..., record...)))``, which
    is combined map-side: a key with millions of duplicates costs one row per
    map task.
    """
    keys = list(keys or [spec.entity])
    order = list(order or [])
    parts = []
    if priority is not None:
        col, values = priority
        rank = F.lit(len(values))
        for i, v in reversed(list(enumerate(values))):
            rank = F.when(F.col(col) == v, F.lit(i)).otherwise(rank)
        parts.append(rank.alias(P + "prio"))
    unordered = {f.name: f.dataType for f in df.schema.fields if f.name not in keys and not orderable(f.dataType)}
    ordered = [c for c in order if c not in unordered] + [
        f.name for f in df.schema.fields if f.name not in order and f.name not in keys and f.name not in unordered
    ]
    # One struct orders and carries the record (no column is buffered twice); columns that
    # Spark has no order for (maps) ride along in a min_by, decided by their canonical forms.
    forms = [canonical(F.col(c), dt).alias(P + "form_" + c) for c, dt in unordered.items()]
    best = F.struct(*parts, *[F.col(c) for c in ordered], *forms)
    aggs = [F.min(best).alias(P + "row")]
    if unordered:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in unordered]), best).alias(P + "rowx"))
    picked = df.groupBy(*keys).agg(*aggs)
    return picked.select(
        *[
            F.col(c) if c in keys else F.col(P + ("rowx" if c in unordered else "row"))[c].alias(c)
            for c in df.columns
        ]
    )
