"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from gavel.plans import QUERIES
from gavel.session import build_session

HEADLINE = (
    "noul_toxic_eval", "evaluation_workflow", "task_dispatch_summary", "latency_profile",
    "value_percentiles", "score_ordinal_eval", "score_spearman", "choice_eval", "macro_leaderboard",
    "ranked_board", "relabel_gold", "item_table", "numeric_answer", "numeric_options_mc4",
    "numeric_options_mc10", "nli_views", "where_filters", "per_dataset_limit", "kfold_assign",
    "holdout_split", "prompt_dedupe_sample", "mirror_counts", "records", "few_shot_pack",
    "request_json", "answer_parse", "softmax_rescale", "contrastive_scores", "scorer_plugin",
    "hypothesis_expand", "cv_summary", "incremental_eval",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session compiles and loads classes: once without a clock.
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
