"""Knowledge-base, web-page and run-log analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from quillstack.session import build_session, load_table, shared_dir

__all__ = ["build_session", "load_table", "shared_dir"]

# Functions sent to workers travel with their code, so a worker needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
