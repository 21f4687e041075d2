"""Records per join task with a planted hot entity (not part of pytest).

    python tests/bench_skew.py <scratch_dir> [sf_dir]

Moves every third order of M1 to one entity (a third of the rows), runs
`attach_modal` with the hot-key split on and off (AQE coalescing and skew join
off, automatic broadcast off, 16 shuffle partitions) and reads the records
read per reduce task of the join stage from Spark's event log.
"""

import glob
import io
import json
import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

import zstandard  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


def main():
    scratch = sys.argv[1]
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    events = os.path.join(scratch, "events")
    os.makedirs(events, exist_ok=True)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.adaptive.skewJoin.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", events)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tierwise import PRESETS, ColumnSpec, attach_modal
    from tierwise.plans import catalog

    hot = catalog._m1_hot(spark, sf)
    for label, min_rows in [("split", 1000), ("no_split", 10**12)]:
        spark.sparkContext.setJobDescription(label)
        out = attach_modal(hot, ColumnSpec(), PRESETS["unknown_not_stated_any_other"], min_rows=min_rows)
        out.write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobDescription(None)
    spark.stop()

    f = sorted(glob.glob(os.path.join(events, "*", "*")))[-1]
    stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(f, "rb")), encoding="utf-8")
    stage_of, reads = {}, {}
    for line in stream:
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            for s in e["Stage IDs"]:
                stage_of[s] = (e.get("Properties") or {}).get("spark.job.description")
        elif e["Event"] == "SparkListenerTaskEnd":
            r = ((e.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
            reads.setdefault(e["Stage ID"], []).append(r)
    out = {}
    for stage, rs in reads.items():
        label = stage_of.get(stage)
        if label and len(rs) > 1 and sum(rs) > 100_000:  # the join stage reads all records
            rs = sorted(rs)
            out[label] = {"tasks": len(rs), "records": sum(rs), "max_task": rs[-1], "median_task": rs[len(rs) // 2]}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
