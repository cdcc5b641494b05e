"""What __spark_entry__.py adds: the operators' queries and SQL, and the pipeline's."""

import corpus_pipeline
from sightline.llm.queries import ORACLE, QUERIES as OPERATORS

QUERIES = {**OPERATORS, "pipeline": corpus_pipeline.run}
ORACLE_SQL = {**ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
