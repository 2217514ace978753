"""Traffic time-series analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function. Clock readings such as
"now" and "today" are arguments, never read inside an operator.
"""

from lanewise.session import build_session, scratch_path, stored

__all__ = ["build_session", "scratch_path", "stored"]
