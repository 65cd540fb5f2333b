"""promoscope: survey / Net Promoter Score analytics as Spark DataFrame jobs.

Layout:
  functions/  Column-expression helpers (JS-compatible parsing, rounding, NPS statistics)
  sources/    dimension tables, survey inputs (driver tables, CSV files), export
  operators/  cleaning, filters, aggregations, matrices, cohorts, themes, verbatims, upsert
  plans/      named query catalogue (what ``__spark_entry__`` registers)
  streaming/  Structured Streaming ingest with an upsert sink
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
