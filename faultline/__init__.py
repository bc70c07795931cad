"""Incident analytics on Spark: ingest, sessionize, correlate, index, retrieve.

Every public operator takes DataFrames and returns a DataFrame. Nothing runs
until the caller starts an action, except the streaming runners and the sinks.
"""

from faultline.session import prepare

__all__ = ["prepare"]
