"""Command-line run: read a table, settle modal and latest, save the results.

    python -m tierwise --input gp_records --dataset GP \\
        --preset unknown_not_stated_any_other --out /shared/results \\
        --entity-col person_id --category-col code --date-col record_date

(on a cluster, submit the same module with ``spark-submit``). Writes
``<out>/<run name>/{latest,resolved,manifest}``; the run name is the preset's.
The Spark session is the cluster's: nothing is configured here.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from .plans.runs import run_and_save
from .plans.spec import DEFAULT_PRESET, PRESETS, ColumnSpec, RunConfig, TierPolicy
from .sources.io import read_input


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tierwise", description=__doc__.splitlines()[0])
    p.add_argument("--input", required=True, help="catalog table name or parquet path")
    p.add_argument("--dataset", required=True, help="GP, HES or IAPT (selects the recency rule)")
    p.add_argument("--preset", default=DEFAULT_PRESET, choices=sorted(PRESETS))
    p.add_argument("--out", required=True, help="base path (or table prefix) for the outputs")
    p.add_argument("--entity-col", default="entity")
    p.add_argument("--category-col", default="category")
    p.add_argument("--date-col", default="observed_at")
    p.add_argument("--source-col", default="source")
    p.add_argument("--flag-col", default="flag")
    p.add_argument("--date-grain", choices=["day", "month", "year"], default=None)
    p.add_argument("--mode", default="overwrite", choices=["overwrite", "errorifexists", "append"])
    p.add_argument("--not-valid", help="comma-separated codes that replace the preset's not-valid list")
    p.add_argument("--other", help="comma-separated codes that replace the preset's other list")
    p.add_argument("--run-name", help="name of the run (default: the preset's); needed with edited lists")
    p.add_argument("--source-order", help="comma-separated source values, best first")
    p.add_argument("--dedupe", action="store_true", help="keep one latest record per entity")
    return p.parse_args(argv)


def _codes(text: str) -> tuple[str, ...]:
    return tuple(c.strip() for c in text.split(",") if c.strip())


def policy_of(args: argparse.Namespace) -> TierPolicy:
    """The preset, with the lists that the command line replaces."""
    policy = PRESETS[args.preset]
    edited = {k: _codes(v) for k, v in (("not_valid", args.not_valid), ("other", args.other)) if v is not None}
    if edited and not args.run_name:
        raise SystemExit("--not-valid and --other need a --run-name: the preset's name would say otherwise")
    if edited:
        edited["reallocate"] = True
    return replace(policy, name=args.run_name or policy.name, **edited)


def main(argv: list[str] | None = None) -> dict[str, str]:
    args = parse(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.getOrCreate()
    spec = ColumnSpec(
        entity=args.entity_col,
        category=args.category_col,
        observed_at=args.date_col,
        source=args.source_col,
        flag=args.flag_col,
        date_grain=args.date_grain,
        **({"source_order": _codes(args.source_order)} if args.source_order else {}),
    )
    config = RunConfig(args.dataset, policy_of(args), spec)
    return run_and_save(read_input(spark, args.input), config, args.out, mode=args.mode, dedupe=args.dedupe)


def cli() -> int:
    """Console entry point: run, print the written locations, exit 0."""
    for name, path in main().items():
        print(f"{name}\t{path}")
    return 0


if __name__ == "__main__":
    sys.exit(cli())
