"""All registered queries."""

from strataloom.plans import catalogue_build, catalogue_clean, catalogue_controls, catalogue_eval, catalogue_inference, catalogue_models, catalogue_pit, catalogue_provenance, catalogue_quality, catalogue_score, catalogue_validation  # noqa: F401
from strataloom.plans.registry import ORACLES, QUERIES  # noqa: F401
