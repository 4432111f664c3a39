"""Recommender analytics as PySpark DataFrame jobs."""

from tastegrid.roles import Roles

__all__ = ["Roles"]
