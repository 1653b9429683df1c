"""Product-text classification and meter forecasting as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from wattshelf.session import build_session, checkpoint_root, delete_scratch, materialise, scratch_path

# The few Python functions travel to the executors with their code, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "checkpoint_root", "delete_scratch", "materialise", "scratch_path"]
