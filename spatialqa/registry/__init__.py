"""All registered queries."""
from spatialqa.registry.base import ORACLES, QUERIES  # noqa: F401
from spatialqa.registry import delivery, geometry, masks, scoring, work  # noqa: F401
