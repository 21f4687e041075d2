"""Write PLANS.md: the physical plan of each operator (not part of pytest).

    python tests/show_plans.py [sf_dir] > PLANS.md
"""

import os
import re
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

from tierwise import (  # noqa: E402
    PRESETS,
    ColumnSpec,
    Rule,
    attach_modal,
    dedupe,
    keep_top_tier,
    latest_by_entity,
    latest_rows,
    modal_by_entity,
    resolve,
)
from tierwise.session import local_session  # noqa: E402
from tierwise.sources.mappings import m1_orders, m2_lineitem  # noqa: E402


def whole_plan(df) -> str:
    """The physical plan with adaptive execution off: every branch that would
    run is in it, also one whose empty result adaptive execution drops later."""
    return df._jdf.queryExecution().executedPlan().toString()


def tree(text, width=150):
    out = []
    for line in text.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        out.append(line if len(line) <= width else line[: width - 3] + "...")
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(cpus=2, shuffle_partitions=8)
    # keep sort-merge joins as at scale (AQE would broadcast these small sides);
    # the hot-key table is broadcast by an explicit hint either way
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spec, pol = ColumnSpec(), PRESETS["unknown_not_stated_any_other"]
    m1, m2 = m1_orders(spark, sf), m2_lineitem(spark, sf)
    cases = [
        ("modal_by_entity (A2)", modal_by_entity(m2, spec, pol)),
        ("latest_by_entity, no rule (A3)", latest_by_entity(m2, spec, Rule.NONE, pol)),
        ("latest_by_entity, source rule (A3)", latest_by_entity(m2, spec, Rule.SOURCE, pol)),
        ("latest_by_entity, flag rule, no re-allocation (A5)", latest_by_entity(m2, spec, Rule.FLAG, PRESETS["none"])),
        ("latest_rows, source rule (A3 records)", latest_rows(m1, spec, Rule.SOURCE, pol)),
        ("latest_rows, flag rule (A3 records at the best key)", latest_rows(m1, spec, Rule.FLAG, pol)),
        ("attach_modal (A2, every record)", attach_modal(m1, spec, pol)),
        ("keep_top_tier (A1)", keep_top_tier(m2, spec, pol)),
        ("resolve (A7)", resolve(m1, spec, pol, Rule.FLAG)),
        ("dedupe (A10)", dedupe(m1, spec, priority=("source", ["apc", "ae", "op"]), order=["o_orderkey"])),
    ]
    print("# PLANS\n")
    print("Physical plans of each operator on the test mappings, generated by")
    print(f"`python tests/show_plans.py {sf}` with adaptive execution and automatic broadcast")
    print("joins off, so that every read is in them and joins stay sort-merge as at scale.")
    print("Expression ids and long lines are trimmed. What to look for: `Exchange` = shuffle")
    print("(`ReusedExchange` = the same shuffle output read again, not a new shuffle);")
    print("`partial_` aggregates run before it (map-side combine); `FileScan ... [columns]`")
    print("lists the only columns read, and `scans` counts the reads of the input; the only")
    print("`BroadcastExchange` is the hot-key table (at most 100,000 rows). Row-preserving")
    print("results look keys up in it whether or not any is hot; the counts behind it come")
    print("from the summary's own shuffle.\n")
    for title, df in cases:
        p = whole_plan(df)
        lines = p.splitlines()
        shuffles = sum(1 for l in lines if "Exchange hashpartitioning" in l and "ReusedExchange" not in l)
        reused = sum(1 for l in lines if "ReusedExchange" in l)
        scans = sum(1 for l in lines if "FileScan" in l)
        print(f"## {title}\n\nshuffles: {shuffles}, reused shuffle reads: {reused}, scans: {scans}, "
              f"windows: {p.count('Window')}\n")
        print("```\n" + tree(p) + "\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
