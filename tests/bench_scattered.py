"""Shuffle bytes when an entity's records are scattered over many files (not part of pytest).

    python tests/bench_scattered.py <scratch_dir> [sf_dir]

The driver's tables are sorted by key, so map-side partial aggregation merges
almost everything and shuffles look better than they would on a large table
where a person's records sit in many files. This writes M2 in random order as
16 files under <scratch_dir> and compares shuffle bytes and time of the
library's aggregation forms with window forms and a bare projection shuffle.
"""

import glob
import io
import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

from functools import reduce  # noqa: E402

import zstandard  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, Window as W  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main():
    scratch = sys.argv[1]
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    events = os.path.join(scratch, "events")
    os.makedirs(events, exist_ok=True)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "200k")
        .config("spark.sql.files.openCostInBytes", "1")
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")  # summaries of large tables are not broadcast
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", events)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tierwise import PRESETS, ColumnSpec, Rule, compare_policies, keep_top_tier, latest_by_entity, modal_by_entity, resolve, summarise
    from tierwise.sources.mappings import m2_lineitem

    path = os.path.join(scratch, "m2_scattered.parquet")
    if not os.path.exists(path):
        src = m2_lineitem(spark, sf, null_flags=True)
        src.withColumn("r", F.rand(11)).repartition(16).sortWithinPartitions("r").drop("r").write.parquet(path)
    m = spark.read.parquet(path)
    spec, pol = ColumnSpec(), PRESETS["unknown_not_stated_any_other"]
    by_e = W.partitionBy("entity")
    tier = F.when(F.col("category").isin(*pol.not_valid), 0).when(F.col("category").isin(*pol.other), 1).otherwise(2)
    cases = {
        "latest_none": latest_by_entity(m, spec, Rule.NONE, pol),
        "latest_source": latest_by_entity(m, spec, Rule.SOURCE, pol),
        "latest_flag": latest_by_entity(m, spec, Rule.FLAG, pol),
        # fixed-width buffers first: a hash aggregate of (entity, category[, source, flag]), then the same method over its rows
        "latest_none_units": latest_by_entity(summarise(m.select("entity", "category", "observed_at"), spec), spec, Rule.NONE, pol),
        "latest_source_units": latest_by_entity(summarise(m.drop("flag"), spec), spec, Rule.SOURCE, pol),
        "latest_flag_units": latest_by_entity(summarise(m.drop("source"), spec), spec, Rule.FLAG, pol),
        "six_policies_one_by_one": reduce(DataFrame.unionByName, [resolve(m, spec, p, Rule.FLAG, clean=False) for p in PRESETS.values()]),
        "six_policies_compared": compare_policies(m, spec, list(PRESETS.values()), Rule.FLAG),
        "top_tier_records": keep_top_tier(m, spec, pol),
        "latest_none_rank_window": m.withColumn(
            "r", F.rank().over(by_e.orderBy(tier.desc(), F.col("observed_at").desc()))
        ).where("r = 1"),
        "modal": modal_by_entity(m, spec, pol),
        "modal_count_windows": m.withColumn("n", F.count("category").over(W.partitionBy("entity", "category")))
        .withColumn("mx", F.max("n").over(by_e)),
        "bare_projection_shuffle": m.select("entity", "category", "observed_at").repartition(8, "entity"),
    }
    secs = {}
    for name, df in cases.items():
        df.write.format("noop").mode("overwrite").save()
        spark.sparkContext.setJobDescription(name)
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        secs[name] = round(time.perf_counter() - t0, 3)
        spark.sparkContext.setJobDescription(None)
    n_tasks = m.rdd.getNumPartitions()
    spark.stop()
    f = sorted(glob.glob(os.path.join(events, "*", "*")))[-1]
    stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(f, "rb")), encoding="utf-8")
    stage_of, shuffle, spilled = {}, {k: 0 for k in cases}, 0
    for line in stream:
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            for s in e["Stage IDs"]:
                stage_of[s] = (e.get("Properties") or {}).get("spark.job.description")
        elif e["Event"] == "SparkListenerTaskEnd" and stage_of.get(e["Stage ID"]) in shuffle:
            metrics = e.get("Task Metrics") or {}
            shuffle[stage_of[e["Stage ID"]]] += metrics.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
            spilled += metrics.get("Disk Bytes Spilled", 0)
    print(json.dumps({"scan_tasks": n_tasks, "sec": secs, "shuffle_mb": {k: round(v / 1e6, 2) for k, v in shuffle.items()}, "spilled": spilled}))


if __name__ == "__main__":
    main()
