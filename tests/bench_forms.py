"""Compare generic plan forms for the two core steps (not part of pytest).

    python tests/bench_forms.py [sf_dir]

Top-1 per entity: window max + equality filter, rank() = 1, groupBy max_by.
Counting per (entity, code): window count, groupBy count.
Latest value with conflict test: this library (one aggregation) and a
rank-window form. Prints one JSON line of best-of-3 seconds.
"""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

from pyspark.sql import Window as W  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tierwise import PRESETS, ColumnSpec, Rule, latest_by_entity, modal_by_entity  # noqa: E402
from tierwise.session import local_session  # noqa: E402
from tierwise.sources.mappings import m2_lineitem  # noqa: E402


def timed(df, n=3):
    runs = []
    for _ in range(n):
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - t0)
    return round(min(runs), 3)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(cpus=8, shuffle_partitions=8)
    m = m2_lineitem(spark, sf)
    pol = PRESETS["unknown_not_stated_any_other"]
    by_e = W.partitionBy("entity")
    forms = {
        "top1_window_max_eq": m.withColumn("mx", F.max("observed_at").over(by_e)).where("observed_at = mx"),
        "top1_rank": m.withColumn("r", F.rank().over(by_e.orderBy(F.col("observed_at").desc()))).where("r = 1"),
        "top1_groupby_max_by": m.groupBy("entity").agg(F.max_by("category", "observed_at").alias("c")),
        "count_window": m.withColumn("n", F.count("category").over(W.partitionBy("entity", "category"))),
        "count_groupby": m.groupBy("entity", "category").agg(F.count("category").alias("n")),
        "modal_library": modal_by_entity(m, ColumnSpec(), pol),
        "latest_library": latest_by_entity(m, ColumnSpec(), Rule.NONE, pol),
    }
    tier = F.when(F.col("category").isin(*pol.not_valid), 0).when(F.col("category").isin(*pol.other), 1).otherwise(2)
    ranked = m.withColumn("r", F.rank().over(by_e.orderBy(tier.desc(), F.col("observed_at").desc()))).where("r = 1")
    forms["latest_rank_window"] = (
        ranked.withColumn("lo", F.min("category").over(by_e))
        .withColumn("hi", F.max("category").over(by_e))
        .select("entity", F.when(F.col("lo") != F.col("hi"), "unresolved").otherwise(F.col("category")).alias("latest"))
        .distinct()
    )
    for df in forms.values():  # warm-up
        df.write.format("noop").mode("overwrite").save()
    print(json.dumps({k: timed(v) for k, v in forms.items()}))
    spark.stop()


if __name__ == "__main__":
    main()
