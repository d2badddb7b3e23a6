"""Executed-plan summary for every catalog key (markdown table on stdout).

Counts shuffles, join strategies, windows and fact-table scans in the final
adaptive plan after running each query into the ``noop`` sink.
"""

from __future__ import annotations

import re
import sys


def stats(plan: str) -> dict[str, int]:
    c = lambda pat: len(re.findall(pat, plan))
    return {
        "shuffle": c(r"\bExchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)"),
        "reused": c(r"ReusedExchange"),
        "bhj": c(r"BroadcastHashJoin"),
        "smj": c(r"SortMergeJoin"),
        "shj": c(r"ShuffledHashJoin"),
        "nlj": c(r"BroadcastNestedLoopJoin|CartesianProduct"),
        "window": c(r"\bWindow\b"),
        "lineitem_scans": c(r"FileScan parquet [^\n]*lineitem\.parquet"),
        "topk": c(r"TakeOrderedAndProject"),
    }


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from shelfcast.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    skip = {"spoilage_model_metrics", "confusion_matrix", "feature_importance", "demand_model_mape",
            "actual_vs_predicted", "recursive_forecast", "score_active_lots",
            "sku_model_mape", "sku_model_forecast", "sku_small_model_mape", "sku_small_model_forecast"}
    spark = build_session()
    cols = ["shuffle", "reused", "bhj", "smj", "shj", "nlj", "window", "lineitem_scans", "topk"]
    print("| key | " + " | ".join(cols) + " |")
    print("| --- |" + " --- |" * len(cols))
    for k, fn in sorted(E.queries().items()):
        if k in skip or k.startswith(("stream_", "op")) or k == "pipeline":
            continue
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = stats(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {k} | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)


if __name__ == "__main__":
    main(sys.argv)
