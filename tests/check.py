"""Command line check: python -m tests.check SF [name-prefix ...]"""
import os
import sys
import time

from levybook.plans import all_queries  # noqa: F401
from levybook.plans.registry import QUERIES, oracles
from levybook.plans.fixtures import Tables
from tests.compare import compare, connect
from tests.session import session

sf, pre = f"/root/testdata/{sys.argv[1]}", sys.argv[2:]
spark, con, sqls = session(os.environ.get("CHECK_CPUS", "8")), connect(sf), oracles()
bad = 0
for n, q in QUERIES.items():
    if pre and not any(n.startswith(p) for p in pre):
        continue
    t0 = time.time()
    try:
        df = q.build(Tables(spark, sf))
        msg = compare(df, con, sqls[n]) if n in sqls else f"rows only: {len(df.collect())}"
    except Exception as e:  # noqa: BLE001
        msg = f"{type(e).__name__}: {str(e)[:900]}"
    if msg and not msg.startswith("rows only"):
        bad += 1
    print(f"{'ok' if not msg else msg:4} {n} {time.time() - t0:.1f}s", flush=True)
print("bad", bad, "of", len(QUERIES))
