"""Imports every query module so that the registry is complete."""
from actuaria.plans import q_models, q_profile, q_scoring, q_similar, q_stream  # noqa: F401
from actuaria.plans.registry import ORACLE, QUERIES  # noqa: F401
