"""python tests/run_checks.py [sf dir] [name prefix ...]: run queries and compare them with their SQL."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from check import compare, connect  # noqa: E402

from impactlens.catalog import QUERIES, SQL, load_all  # noqa: E402
from impactlens.session import build_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    load_all()
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in SQL:
                problem = compare(df, con, SQL[name])
            else:
                rows = df.collect()
                problem = None if rows else "no rows"
                if len(rows) <= 3:
                    print("     ", *[str(r)[:300] for r in rows], sep="\n      ")
        except Exception as e:
            problem = (str(e) or repr(e))[:900]
            if "-v" in wanted:
                traceback.print_exc()
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - t:6.1f}s {'sql ' if name in SQL else 'rows'} {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
