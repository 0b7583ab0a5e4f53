"""What the entry module registers: the operators' queries and the pipeline."""

import corpus_pipeline
from quarrylight.llm.queries import ORACLES as _ORACLES
from quarrylight.llm.queries import QUERIES as _QUERIES

QUERIES = {**_QUERIES, "pipeline": corpus_pipeline.run}
ORACLES = {**_ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
