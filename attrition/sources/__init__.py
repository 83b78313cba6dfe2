"""Sources, sinks and derived fixtures."""

from attrition.sources.tables import table  # noqa: F401
