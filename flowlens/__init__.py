"""Behaviour analytics for device traffic and event streams, as PySpark DataFrame operators."""
