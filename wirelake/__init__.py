"""Spark-native news and trend analytics engine."""

from wirelake.session import get_session, stage, table, workdir

__all__ = ["get_session", "stage", "table", "workdir"]
