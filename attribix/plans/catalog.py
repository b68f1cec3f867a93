"""All registered queries; importing a plan module registers its queries."""

from attribix.plans import audits, effects, families, keypoints, labelling, learning, logistic, profiles, scans, sequences, stored, teams  # noqa: F401
from attribix.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
