"""The pipeline at the repository top as a query."""

import corpus_pipeline

QUERIES = {"pipeline": corpus_pipeline.run}
ORACLES = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
