"""spindex: web-page indexing and keyword retrieval expressed as Spark jobs.

Layout
------
functions/  Column -> Column expressions (text, Porter stemmer, URLs, HTML).
operators/  DataFrame -> DataFrame operators (postings, search, link graph,
            merges, images, scans, stats).
sources/    readers for the input tables and the append/merge sinks.
plans/      the named query catalog used by ``__spark_entry__`` and bench.
streaming/  Structured Streaming versions of the ingest operators.
"""

__all__ = ["session"]
