"""tidewatt: Spark-native time-series, forecast and storage-dispatch analytics.

Every operator is a pure ``DataFrame -> DataFrame`` function keyed by a
``series_id`` (zone / asset / meter).  Windows are always partitioned by that
key, joins are equi or bounded range joins, and the only Python on the hot
path is the grouped dispatch solver (``operators.dispatch``) and the stateful
rate limiter (``streaming.rate_limit``).
"""

from tidewatt.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
