"""Seconds, input rows/s and shuffle bytes per operator (not part of pytest).

    python tests/bench_shuffle.py [sf_dir] [event_log_dir]

Reads Spark's event log (written to a scratch folder) for the shuffle bytes
written by each timed job. Compares the library's aggregation forms with a
window form of the same step.
"""

import glob
import io
import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

import zstandard  # noqa: E402
from pyspark.sql import SparkSession, Window as W  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="tierwise-events-")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tierwise import PRESETS, ColumnSpec, Rule, latest_by_entity, modal_by_entity, resolve
    from tierwise.sources.mappings import m2_lineitem

    spec, pol = ColumnSpec(), PRESETS["unknown_not_stated_any_other"]
    m = m2_lineitem(spark, sf)
    n_in = m.count()
    by_e = W.partitionBy("entity")
    tier = F.when(F.col("category").isin(*pol.not_valid), 0).when(F.col("category").isin(*pol.other), 1).otherwise(2)
    cases = {
        "modal": modal_by_entity(m, spec, pol),
        "latest_none": latest_by_entity(m, spec, Rule.NONE, pol),
        "latest_source": latest_by_entity(m, spec, Rule.SOURCE, pol),
        "latest_flag": latest_by_entity(m, spec, Rule.FLAG, pol),
        "resolve_flag": resolve(m, spec, pol, Rule.FLAG),
        "window_form_count": m.withColumn("n", F.count("category").over(W.partitionBy("entity", "category")))
        .withColumn("mx", F.max("n").over(by_e)),
        "window_form_latest": m.withColumn("r", F.rank().over(by_e.orderBy(tier.desc(), F.col("observed_at").desc())))
        .where("r = 1"),
    }
    secs = {}
    for name, df in cases.items():
        df.write.format("noop").mode("overwrite").save()  # warm-up
        spark.sparkContext.setJobDescription(name)
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        secs[name] = time.perf_counter() - t0
        spark.sparkContext.setJobDescription(None)
    spark.stop()
    shuffle = {k: 0 for k in cases}
    stage_of = {}
    f = sorted(glob.glob(os.path.join(log_dir, "*", "*")))[-1]
    stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(f, "rb")), encoding="utf-8")
    for line in stream:
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            desc = (e.get("Properties") or {}).get("spark.job.description")
            for s in e["Stage IDs"]:
                stage_of[s] = desc
        elif e["Event"] == "SparkListenerTaskEnd":
            desc = stage_of.get(e["Stage ID"])
            if desc in shuffle:
                w = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics", {})
                shuffle[desc] += w.get("Shuffle Bytes Written", 0)
    out = {
        k: {"sec": round(secs[k], 3), "rows_per_sec": int(n_in / secs[k]), "shuffle_bytes": shuffle[k]}
        for k in cases
    }
    print(json.dumps({"input_rows": n_in, "sf_dir": sf, "forms": out}))


if __name__ == "__main__":
    main()
