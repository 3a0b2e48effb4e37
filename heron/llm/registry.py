"""The opN_ queries, the pipeline query and their oracles."""

from __future__ import annotations

import corpus_pipeline
from heron.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLES = {**queries.ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
