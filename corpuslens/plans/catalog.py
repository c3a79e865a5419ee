"""All registered queries in one place."""

from corpuslens.plans import evaluation_queries, index_queries, sequence_queries, source_queries, text_queries, vocabulary_queries  # noqa: F401
from corpuslens.plans.registry import ORACLE, QUERIES  # noqa: F401
