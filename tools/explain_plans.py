"""Write PLANS.md: per registered query the exchange / join counts of its physical plan,
plus the formatted plans of a few representative queries.

Usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mentionkit.plans.catalog import QUERIES  # noqa: E402
from mentionkit.session import build_session  # noqa: E402

#: They train when they are planned.
MODEL_JOBS = {"k1_forest_3class", "k1_softmax_boosting", "k2_pairwise_gbt", "k3_search_pairwise", "k3_search_refit_predict",
              "k4_linear_pair_ranker", "k4_shared_pair_ranker", "s5_model_roundtrip", "s5_trained_scorers"}
SHOWN = ["a1_mention_profile", "w3_positional_window", "j9_span_pieces"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    qs = QUERIES
    qs["fixture_mentions"](spark, sf).count()           # stage the shared tables first
    lines = ["# Physical plans", "",
             f"Planned on `{sf}` (local). Counts are operators in the executed plan; "
             "broadcasts are Spark's own size-based choice except for fixed-size dimensions.", "",
             "| query | exchanges | sort-merge joins | broadcast hash joins | nested-loop / cartesian |",
             "|---|---|---|---|---|"]
    shown = {}
    for name, fn in qs.items():
        if name in MODEL_JOBS:
            continue
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        bad = sum(plan.count(k) for k in ("BroadcastNestedLoopJoin", "CartesianProduct"))
        lines.append(f"| {name} | {plan.count('Exchange')} | {plan.count('SortMergeJoin')} | "
                     f"{plan.count('BroadcastHashJoin')} | {bad} |")
        if name in SHOWN:
            buf = io.StringIO()
            with contextlib.redirect_stdout(buf):
                df.explain("formatted")
            shown[name] = buf.getvalue()
    for name in SHOWN:
        lines += ["", f"## {name}", "", "```", shown[name].strip(), "```"]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
