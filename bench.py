"""Time the headline queries: python bench.py prints one JSON line.

Every query runs once to warm the JVM and the Python workers, then is timed twice over
its whole tables, and the better time counts.  Results are produced in full (noop sink).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sentence_split",
    "table_blocks",
    "chunk_fold",
    "chunk_fold_sections",
    "chunk_fold_v1",
    "ingest_stats",
    "extract_pages",
    "hash_encode",
    "embedding_index",
    "embedding_validation",
    "knn_topk",
    "knn_filtered",
    "knn_multi_query",
    "similar_items_excl_self",
    "query_expansion_documents",
    "dedup_corpus",
    "retrieve",
    "retrieve_chunks",
    "answer_questions",
    "rubric_score",
    "eval_overall",
    "year_distribution",
    "append_collection",
    "stored_collection",
    "get_by_id",
    "ingest_run",
]


def main():
    from sparquill.queries import QUERIES
    from sparquill.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores)

    def run(name):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name)
        seconds[name] = round(min(run(name), run(name)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
