"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# From text to counted words, then the derived tables, then searches on the stored result.
HEADLINE = [
    "conllu_lexicon", "conllu_tokens", "vrt_tokens", "lexicon_build", "merge_lexicons", "rejected_tokens",
    "lemma_ambiguity", "form_ambiguity", "feature_ids",
    "bigram_freqs", "word_bigram_freqs", "hood_with_lexicon", "edit1_counts", "edit1_neighbours",
    "search_topk", "search_order_by", "filter_numeric", "filter_middle", "filter_end_indexed",
    "filter_long_list", "clitic_in",
    "wordlist_forms", "top_n_per_form", "relative_freqs",
    "aggregate_sum", "aggregate_count", "prune_frequency", "merge_incremental",
    "combined_export",
]


# Seconds below which a query is run three times.
SHORT = 4


def main() -> None:
    from checks import fixture
    from checks.queries import queries
    from lexloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")

    seconds: dict[str, float] = {}

    def timed(name, run, again: bool = False) -> None:
        """Seconds of a run; for short ones the median of three."""
        runs: list[float] = []
        while not runs or again and len(runs) < 3 and max(runs) < SHORT:
            start = time.perf_counter()
            run()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(median(runs), 3)

    # Class loading and code generation are paid here, on the smallest job.
    fixture.documents(spark, sf_dir).limit(1).count()
    # Input text for the corpus scan; writing it is no part of the engine.
    fixture.conllu_text(spark, sf_dir)
    fixture.vrt_text(spark, sf_dir)
    # The stored tables the later queries read are timed on their own.
    timed("store_words", lambda: fixture.stored_words(spark, sf_dir))
    timed("store_lexicon", lambda: fixture.lexicon(spark, sf_dir))
    timed("stored_forms", lambda: fixture.stored_forms(spark, sf_dir))
    timed("store_indexes", lambda: fixture.indexed_lexicon(spark, sf_dir))
    # The base that later words are merged into: the same work as store_lexicon, so not timed again.
    fixture.earlier_lexicon(spark, sf_dir)
    for name in HEADLINE:
        run = queries()[name]
        timed(name, lambda: run(spark, sf_dir).write.format("noop").mode("overwrite").save(), again=True)

    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
