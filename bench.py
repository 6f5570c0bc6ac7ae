"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pressgauge.plans.catalog import QUERIES  # noqa: E402
from pressgauge.session import READ_PARTITIONS, build_session  # noqa: E402

HEADLINE = [
    "normalize_headlines",
    "body_keys",
    "clean_text",
    "fingerprint_survey",
    "cleaning_loss",
    "input_profile",
    "input_gate",
    "corpus_top_up",
    "top_up_report",
    "corpus_status",
    "headline_lookup",
    "body_lookup",
    "cascade",
    "cascade_by_method",
    "leak_drop",
    "blocklist",
    "diverse_select",
    "rejection_tally",
    "spread_sample",
    "stratified_split",
    "composition",
    "cutoff_sweep",
    "choose_cutoff",
    "verdict_stats",
    "flag_band",
    "unsure_band",
    "compare_cutoffs",
    "sorting_score",
    "classification_report",
    "dashboard",
    "recent_20",
    "web_queue",
    "web_replies",
    "tfidf_train_eval",
    "linear_train_eval",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "pressgauge-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(READ_PARTITIONS, cpus)  # the test tables have one row group each
    spark.read.parquet(f"{folder}/documents.parquet").count()  # JVM and reader warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
