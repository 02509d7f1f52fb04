"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from impactlens.catalog import QUERIES, load_all
from impactlens.session import build_session

HEADLINE = (
    "flagship_week_leaders",
    "j2_label_12m_long",
    "a6_j5_field_normalised",
    "w4_w6_impact_rank",
    "w5_top_by_impact",
    "e3_e4_a10_mean_ndcg",
    "e1_spearman",
    "a1_coauthor_edges",
    "g3_pagerank_20",
    "g6_clustering",
    "f1_tfidf_weights",
    "j9_nearest_older",
    "d5_subscribers",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = build_session(
        f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["e5_j8_precision_at_k"](spark, sf).collect()  # start-up is not part of any query
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
