"""sparktab: tabular profiling, cleaning, features, models and run analytics
written as plain ``DataFrame -> DataFrame`` functions on Spark."""

from sparktab.session import get_session, ensure_checkpoint_dir, checkpoint_path

__all__ = ["get_session", "ensure_checkpoint_dir", "checkpoint_path"]
