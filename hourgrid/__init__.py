"""Hourly sensor analytics as plain PySpark DataFrame operators."""

from hourgrid.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
