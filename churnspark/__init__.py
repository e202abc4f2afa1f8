"""churnspark: customer-churn analytics as Spark DataFrame, MLlib and Structured Streaming jobs.

Layout
------
sources/    readers and sinks (topic files, upload CSV, versioned tables, log append, export)
functions/  Column-level scalar rules (coercion, labels, risk bands, formats, checks)
operators/  DataFrame -> DataFrame operators (cleaning, merge/upsert, analytics, ranks, metrics)
plans/      composed jobs: chart specs, data versions, the ingest job, driver-table stand-ins
ml/         MLlib feature pipeline, training, evaluation and scoring
streaming/  Structured Streaming jobs (continuous scoring, continuous upsert)
"""

__version__ = "0.1.0"
