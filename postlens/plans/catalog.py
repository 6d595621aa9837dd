"""All registered queries; importing the modules fills the registry."""

from . import composed_queries, feature_queries, io_queries, model_queries, result_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLE, QUERIES
from .result_queries import flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]
