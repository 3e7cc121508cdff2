"""python tests/check.py [sf_dir] [name-prefix ...]: compare queries with their oracles and time them."""

import importlib
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
import workload  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    from fieldecho.session import get_session
    mods = [m for m in os.listdir(os.path.dirname(workload.__file__)) if m.endswith(".py") and m not in ("__init__.py", "base.py")]
    for m in mods:
        importlib.import_module(f"workload.{m[:-3]}")
    spark = get_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    bad = 0
    for name, fn in workload.QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in workload.ORACLES:
                diff = oracle.compare(df, con, workload.ORACLES[name])
            else:
                n = df.count()
                diff = [] if n else ["no rows"]
        except Exception as e:  # report and go on
            diff = [f"{type(e).__name__}: {str(e)[:600]}"]
            if os.environ.get("TB"):
                traceback.print_exc()
        bad += bool(diff)
        print(f"{'OK  ' if not diff else 'FAIL'} {name:32s} {time.time() - t:6.2f}s {'' if name in workload.ORACLES else '(rows only)'}",
              *[str(x)[:900] for x in diff], sep="\n     " if diff else " ", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
