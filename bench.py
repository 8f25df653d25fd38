"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from doclens import catalog  # noqa: E402
from doclens.session import local_session  # noqa: E402

HEADLINE = [
    "rank_with_skills", "rank_by_similarity", "score_similarity", "predict_knn", "structured_features",
    "extract_skills", "clean_text", "preprocess_documents", "parse_sections", "embed_documents", "tfidf",
    "dedup_exact", "clean_documents", "adapt_screening_table", "assign_stratified_holdout", "train_test_split",
    "oversample", "profile_dataset", "profile_dataset_lineitem", "normalize_tokens_lemma", "ingest_uploads",
    "classification_report", "calibration_error", "fit_logistic", "screen_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8, spark__ui__showConsoleProgress="false")
    queries = catalog.load()[0]
    # start the Python workers and compile the common paths before timing
    queries[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name,
            }
        )
    )


if __name__ == "__main__":
    main()
