"""All registered queries of the subpackage."""

from docledger.llm import queries_models, queries_near, queries_negatives, queries_phrases, queries_text, queries_web  # noqa: F401
from docledger.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
