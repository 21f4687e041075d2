"""Check every catalogue query against its DuckDB oracle: python tests/run_oracle.py [sf_dir] [names...]"""
import sys, time
import os
HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE)); sys.path.insert(0, HERE)
import __spark_entry__ as E
from oracle import duck, compare
from tierwise.session import local_session
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2:] 
spark = local_session(cpus=8, shuffle_partitions=8)
con = duck(sf)
qs, sqls = E.queries(), E.oracle_sql()
bad = 0
for name, fn in qs.items():
    if only and name not in only: continue
    t = time.time()
    try:
        n, probs = compare(spark, con, sf, fn, sqls[name])
    except Exception as e:
        n, probs = -1, [repr(e)[:800]]
    bad += bool(probs)
    print(f"{'OK ' if not probs else 'BAD'} {name:32s} rows={n:7d} {time.time()-t:5.1f}s", *probs, flush=True)
print("missing oracle:", [k for k in qs if k not in sqls], "extra oracle:", [k for k in sqls if k not in qs])
print("BAD count", bad)
