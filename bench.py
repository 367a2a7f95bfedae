"""Wall-clock of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from docloom.catalog import QUERIES
from docloom.session import get_spark

HEADLINE = [
    "split_label_counts",
    "block_split",
    "remap_labels",
    "write_tsv_pair",
    "clean_text",
    "special_token_census",
    "length_profile",
    "word_frequency",
    "bigram_frequency",
    "top_bigrams",
    "truncate_pad",
    "mlm_mask",
    "bpe_word_counts",
    "bpe_pair_counts",
    # Learns the vocabulary; the next one only encodes with it.
    "bpe_learn",
    "bpe_encode",
    "ngram_lm_perplexity",
    "evaluate_multilabel",
    "train_multilabel",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the JVM and of the Python workers is not what is measured: two queries run unmeasured.
    for name in ("clean_text", "split_label_counts"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
