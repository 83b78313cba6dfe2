"""Operators of a training-data pipeline (sharding, deduplication, filtering,
packing).  Nothing else in the library imports this subpackage; its queries
are added in ``__spark_entry__`` only when it can be imported."""
