"""tidemark: privacy-aware web analytics as Spark DataFrame operators.

Subpackages:

* ``sources`` / ``sinks`` - the Parquet lake (site_id / dt / batch_id), raw
  requests, fixed-schema JSON, value rows; routing, rejects, compaction.
* ``operators`` - ingest checks and enrichment, scoped read, session model,
  segments, headline numbers, breakdowns, page flow, usage, billing, sites.
* ``functions`` - Column helpers (URL parts, user-agent rules, formatting).
* ``plans`` - jobs (replay-safe ingest), the dashboard, parameters, sizing.
* ``streaming`` - Structured Streaming ingest into the lake.
"""

__version__ = "0.1.0"
