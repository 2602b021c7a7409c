"""Station and grid time-series analytics expressed as Spark DataFrame jobs."""

from insolara.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
