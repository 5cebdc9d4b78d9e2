"""Print the physical plan of registered checks, reduced to the operators
that matter at scale (exchanges, joins, aggregates, windows, generators,
scans with their pushed filters and read schema).

    python tools/show_plans.py [--sf DIR] name [name ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = re.compile(r"(Exchange|Join|Aggregate|Window|Generate|FileScan|BroadcastExchange|"
                  r"FlatMapCoGroupsInPandas|MapInPandas|ArrowEvalPython|Subquery|Sort |"
                  r"WindowGroupLimit|ReusedExchange|Union|Expand)")


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="+")
    args = ap.parse_args()
    from quarry.plans.registry import load_all
    from quarry.session import get_spark
    checks = load_all()
    spark = get_spark("local[8]", shuffle_partitions=8)
    for n in args.names:
        df = checks[n].fn(spark, args.sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"### {n}\n```")
        for line in plan.splitlines():
            if KEEP.search(line):
                line = re.sub(r"#\d+L?", "", line)
                line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^]]*\], ", "", line)
                line = re.sub(r"(lambdafunction\(|regexp_extract_all\().{80,}", r"\1...", line)
                print(line[:230])
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
