"""postline: ingest, normalise, score, merge and publish job-posting records on Spark.

Sub-packages:

* ``functions``  column expressions (text, URLs, dates, identity, regex dialects, exact variants)
* ``operators``  DataFrame operators (eligibility, scoring, merge, exports, explore,
                 request log, runs, snapshots, ordering)
* ``sources``    payload readers and inputs derived from the driver tables
* ``plans``      registered queries, DuckDB oracle SQL, the end-to-end workflow run
* ``streaming``  Structured Streaming ingest and running first/last seen
"""

__version__ = "0.1.0"
