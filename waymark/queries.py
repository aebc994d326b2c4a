"""Queries over the star-schema tables and the SQL that gives the same rows."""

from .plans import catalogue, evidence, heights, journeys, lines, matching, network, parts, profiles, scores, space, tags  # noqa: F401  each registers its queries
from .plans.base import ORACLE_SQL, QUERIES  # noqa: F401
