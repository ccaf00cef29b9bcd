"""All registered queries outside the ``llm`` subpackage, with their SQL."""

from __future__ import annotations

from quillspan.plans import answers_queries, calls, cascade_queries, general, scoring, similarity_queries, source_queries, vocabulary_queries

MODULES = (general, scoring, answers_queries, similarity_queries, vocabulary_queries, calls, cascade_queries, source_queries)

FLAGSHIP = "score_models"
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
