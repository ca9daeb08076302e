"""Headline benchmark: runs registered queries over ``$BENCH_SF_DIR`` on
``local[$BENCH_CPUS]`` and prints one JSON line.

Each query is executed in full through Spark's ``noop`` sink (nothing is
collected to the driver); the reported time is the best of ``$BENCH_REPS``
runs after one JVM warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tandem.plans.catalog import QUERIES  # noqa: E402
from tandem.session import local_session  # noqa: E402

HEADLINE = [
    "clean_pairs", "dense_index", "split_ordered", "vocab_first_seen", "vocab_by_freq", "encode",
    "decode", "tokenize_lr", "cohesion_scores", "pivot_pairs", "learn_lexicon", "translate",
    "align", "nll", "sentence_bleu", "corpus_bleu_mean", "bucket_batches", "increase_streak",
]


def run(spark, name: str, sf: str) -> float:
    t0 = time.time()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "words", sf)  # warm-up: JVM, parquet footers, code generation
    times = {}
    for n in names:
        times[n] = round(min(run(spark, n, sf) for _ in range(reps)), 3)
    sf_name = os.path.basename(sf.rstrip("/"))
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_name.replace("sf", "") if sf_name.startswith("sf") else sf_name,
    }))


if __name__ == "__main__":
    main()
