"""python tests/run_compare.py SF_DIR [query …] — compare and time registered queries."""

import sys
import time

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

from meterloom.plans.catalog import ORACLES, QUERIES  # noqa: E402
from meterloom.session import local_session  # noqa: E402
from tests.compare import compare, duck  # noqa: E402

sf, names = sys.argv[1], sys.argv[2:]
spark, con = local_session(8), duck(sf)
bad = []
for name in names or list(QUERIES):
    t = time.time()
    try:
        if name not in ORACLES:
            df = QUERIES[name](spark, sf)
            rows = df.collect()
            print(f"rows  {name:32s} {len(rows):7d} {time.time() - t:6.2f}s {df.dtypes}")
            for x in rows[:2]:
                print("      ", x)
            continue
        same, s, d, diff, cols = compare(spark, con, sf, QUERIES[name], ORACLES[name])
        ok = same and s == d
        print(f"{'ok   ' if ok else 'DIFF '} {name:32s} {len(s):7d} {len(d):7d} {time.time() - t:6.2f}s")
        if not ok:
            bad.append(name)
            print("   ", cols if not same else "", *diff, sep="\n    ")
    except Exception as e:  # noqa: BLE001
        bad.append(name)
        print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:1500]}")
print("bad:", bad)
