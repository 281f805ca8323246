"""cohortkit: customer segmentation (RFM, ABC, LRFMS, clustering) as Spark jobs."""

import sys as _sys

from cohortkit.session import ensure_checkpoint_dir, get_session

try:  # ship the NumPy kernels with the tasks: workers need not import the package
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, ValueError):  # pragma: no cover
    pass

__all__ = ["get_session", "ensure_checkpoint_dir"]
