"""All registered queries; importing this module fills the registry."""

from chorale.plans.registry import QUERIES
from chorale.plans import q_base, q_documents, q_labels, q_metrics, q_outcomes, q_sources, q_survey, q_thresholds  # noqa: F401

__all__ = ["QUERIES"]
