"""End-to-end runs: clean, resolve modal and latest, manifest, save."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedupe import dedupe as dedupe_rows
from ..operators.latest import _resolve_rule, latest_rows, latest_value_by_entity
from ..operators.modal import modal_by_entity
from ..operators.summary import N_RECORDS, summarise
from .spec import RESERVED_PREFIX, UNRESOLVED, ColumnSpec, Rule, RunConfig, TierPolicy

P = RESERVED_PREFIX


def prepare(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """Remove records with a NULL entity or a NULL code (the documented pre-step).

    NULL codes would otherwise sit in the top tier and beat real low-tier
    codes; NULL entities would form one pseudo-entity.
    """
    spec = spec.resolved(df)
    return df.na.drop(subset=[spec.entity, spec.category])


def sentinel_rows(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """Input records whose code is the result marker ``unresolved`` (lazy)."""
    return df.where(F.col(spec.category) == UNRESOLVED)


def check_no_sentinel(df: DataFrame, spec: ColumnSpec) -> None:
    """Raise if any input code equals ``unresolved``, which the results could
    not tell apart from a tie. Opt-in: it runs a (short-circuiting) job."""
    if not sentinel_rows(df, spec).isEmpty():
        raise ValueError(f"input has {spec.category!r} codes equal to {UNRESOLVED!r}")


def resolve(
    df: DataFrame,
    spec: ColumnSpec,
    policy: TierPolicy,
    rule: Rule | str,
    *,
    clean: bool = True,
    modal_col: str = "modal",
    latest_col: str = "latest",
    no_null_entity: bool | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per entity: ``entity, modal, latest``.

    ``df`` holds records, or a summary of them (:mod:`tierwise.operators.summary`)
    whose ``weight`` column says how many records a row stands for.

    ``policy.reallocate`` chooses the re-allocated forms or the plain ones.
    The modal summary (two partially aggregated shuffles) and the latest
    summary (one) are both hash-partitioned by the entity, so joining them
    adds no shuffle. ``latest`` is NULL for an entity with no eligible
    record; where a NULL code shares the latest date with a real code (only
    possible without ``clean``), the real code is reported. With ``clean``
    (default) the input first goes through :func:`prepare`. ``no_null_entity``
    says that the input has no NULL entity, however it came to that (default:
    as ``clean`` says); a plain join then keeps the shared partitioning.

    (A single scan feeding both summaries through one ``groupBy(entity,
    code)`` was measured too: it shuffled 2.4-2.7 times more bytes, because
    every per-code row then carries all the modal and latest buffers.)
    """
    rule = _resolve_rule(rule)
    spec = spec.resolved(df, rule)
    if clean:
        df = prepare(df, spec)
    modal = modal_by_entity(df, spec, policy, out=modal_col, weight=weight)
    latest = latest_value_by_entity(df, spec, rule, policy, out=latest_col)
    if clean if no_null_entity is None else no_null_entity:
        return modal.join(latest, on=spec.entity, how="left")
    latest = latest.withColumnRenamed(spec.entity, P + "le")
    joined = modal.join(latest, F.col(spec.entity).eqNullSafe(F.col(P + "le")), how="left")
    return joined.select(spec.entity, modal_col, latest_col)


def _dedupe_options(dedupe) -> dict | None:
    if dedupe is None or dedupe is False:
        return None
    return {} if dedupe is True else dict(dedupe)


def _latest_with_modal(df: DataFrame, config: RunConfig, modal: DataFrame, dedupe, opts: dict, summary: DataFrame | None = None) -> DataFrame:
    """The latest records, each with its entity's modal value, which rides along
    on the way that the entity's latest result takes anyway."""
    latest = latest_rows(df, config.spec, config.rule, config.policy, entity_cols=modal, summary=summary, **opts)
    options = _dedupe_options(dedupe)
    return latest if options is None else dedupe_rows(latest, config.spec, **options)


def run(df: DataFrame, config: RunConfig, *, clean: bool = True, dedupe: dict | bool | None = None, **opts) -> dict[str, DataFrame]:
    """The documented run: both methods for one data source and policy.

    Returns ``latest`` (the latest-category records, each carrying its
    entity's ``modal`` value, which is what the original two-step script
    produces), ``resolved`` (one row per entity) and ``manifest``.
    ``dedupe`` (True, or the options of :func:`tierwise.operators.dedupe.dedupe`)
    keeps one latest record per entity, as GP runs need.
    """
    config = replace(config, spec=config.spec.resolved(df, config.rule))
    spec, policy = config.spec, config.policy
    raw = df
    if clean:
        df = prepare(df, spec)
    return {
        "latest": _latest_with_modal(df, config, modal_by_entity(df, spec, policy), dedupe, opts),
        "resolved": resolve(df, spec, policy, config.rule, clean=False, no_null_entity=clean),
        "manifest": manifest(df.sparkSession, config.dataset, policy, raw=raw if clean else None, spec=spec),
    }


def run_and_save(
    df: DataFrame,
    config: RunConfig,
    base: str,
    *,
    mode: str = "overwrite",
    clean: bool = True,
    dedupe: dict | bool | None = None,
    **opts,
) -> dict[str, str]:
    """The documented run, written so that each piece is computed once: below
    ``<base>/<run name>/`` where ``base`` is a path, else to catalog tables
    ``<base>_<run name>_<output>``.

    A policy-free summary of the records (:mod:`tierwise.operators.summary`) is
    written first. The results per entity, the manifest's counts and the best keys
    of the flag rule come from that table, and the latest records take their modal
    values from the written results, so the records are read twice in all: for the
    summary and for the latest records. Written tables also cut the lineage: a
    lost executor later costs a re-read, not a recomputation. With
    ``mode="append"`` the tables then hold earlier runs too (the summary stays one:
    ``merge_summaries`` of the table stands for all runs' records), so this run's
    values are computed from its own input instead. ``"ignore"`` is refused: it
    would join one run's values to another's records wherever an earlier run wrote
    only some of the outputs. Returns the written locations.
    """
    from ..sources.io import output_name, read_saved, save

    if mode == "ignore":
        raise ValueError("mode 'ignore' could mix two runs; use 'errorifexists', 'overwrite' or 'append'")
    config = replace(config, spec=config.spec.resolved(df, config.rule))
    spec, policy, spark = config.spec, config.policy, df.sparkSession
    written = {name: output_name(base, policy.name, name) for name in ("summary", "resolved", "latest", "manifest")}
    whole = summarise(df, spec)
    save(whole, written["summary"], mode=mode)
    if mode != "append":
        whole = read_saved(spark, written["summary"])
    records, summary = (prepare(df, spec), prepare(whole, spec)) if clean else (df, whole)
    resolved = resolve(summary, spec, policy, config.rule, clean=False, no_null_entity=clean, weight=N_RECORDS)
    save(resolved, written["resolved"], mode=mode)
    modal = resolved if mode == "append" else read_saved(spark, written["resolved"])
    latest = _latest_with_modal(records, config, modal.select(spec.entity, "modal"), dedupe, opts, summary)
    save(latest, written["latest"], mode=mode)
    info = manifest(spark, config.dataset, policy, raw=whole if clean else None, spec=spec, weight=N_RECORDS)
    save(info.coalesce(1), written["manifest"], mode=mode)
    return written


MANIFEST_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("Datasource", "Reallocation", "Name", "Counts", "Comments")]
)


def manifest(
    spark: SparkSession,
    dataset: str,
    policy: TierPolicy,
    extra: list[tuple[str, str, str]] | None = None,
    *,
    raw: DataFrame | None = None,
    spec: ColumnSpec | None = None,
    weight: str | None = None,
) -> DataFrame:
    """The run manifest: which lists and which run name were used.

    Three rows (not-valid list, other list, run name), plus any ``extra``
    (name, counts, comment) rows the caller records. With ``raw`` (the input
    before :func:`prepare`) and ``spec``, a row "Rows removed by prepare" is
    added whose count Spark computes from the input when the manifest is
    written (lazily, one aggregation); ``raw`` may be a summary of the input,
    whose ``weight`` column says how many records a row stands for.
    """
    rows = [
        (dataset, policy.name, "Not valid list", str(list(policy.not_valid)), ""),
        (dataset, policy.name, "Other list", str(list(policy.other)), ""),
        (dataset, policy.name, "Name of run", policy.name, ""),
    ]
    for name, counts, comment in extra or []:
        rows.append((dataset, policy.name, name, str(counts), comment))
    out = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    if raw is not None:
        if spec is None:
            raise ValueError("counting removed rows needs the ColumnSpec")
        removed = raw.where(F.col(spec.entity).isNull() | F.col(spec.category).isNull()).agg(
            F.lit(dataset).alias("Datasource"),
            F.lit(policy.name).alias("Reallocation"),
            F.lit("Rows removed by prepare").alias("Name"),
            (F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))).cast("string").alias("Counts"),
            F.lit("").alias("Comments"),
        )
        out = out.unionByName(removed)
    return out
