"""Headline-query benchmark.

Runs the main catalog queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line.
Each query is forced to full evaluation with a ``noop`` write (every row is
computed, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spindex.plans import catalog  # noqa: E402
from spindex.session import local_session  # noqa: E402

HEADLINE = (
    "tx_term_counts_stemmed",   # stemmed inverted index of the documents
    "hx_term_counts_stemmed",   # HTML extraction + stemmed page index
    "hx_links",                 # link extraction and resolution
    "lg_degrees",               # link graph: backlinks and degrees
    "se_ranked_documents",      # batch search: index build + top-50 + score + rank
    "se_ranked_literal",        # batch search, literal scoring
    "se_results_pages",         # page index + search + result-page join
)

INDEXES = {"build_document_index": catalog.document_index, "build_page_index": catalog.page_index}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus)
    names = sys.argv[1:] or list(HEADLINE)
    times: dict[str, float] = {}
    for name, build in INDEXES.items():
        if not sys.argv[1:]:
            t0 = time.time()
            build(spark, sf_dir)   # written once; the searches below read it
            times[name] = round(time.time() - t0, 3)
    for name in names:
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)   # may run eager checkpoint jobs
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
