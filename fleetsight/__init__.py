"""Spark-native analytics over node telemetry and security events."""

from fleetsight.session import get_session

__all__ = ["get_session"]
