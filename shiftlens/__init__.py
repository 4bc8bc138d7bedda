"""Cohort risk analytics as plain Spark DataFrame functions."""

from shiftlens.session import get_session

__all__ = ["get_session"]
