"""Importing this module registers every query."""

from boxtrail.plans import (  # noqa: F401
    curation_queries,
    geometry_queries,
    learning_queries,
    matching_queries,
    selection_queries,
    source_queries,
    stream_queries,
    window_queries,
)
from boxtrail.plans.registry import ORACLES, QUERIES  # noqa: F401
