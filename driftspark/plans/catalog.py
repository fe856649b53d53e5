"""All queries by name, and the SQL that says the same."""

from . import model_queries, score_queries, split_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
