"""Policy-evidence analytics as Spark jobs.

The package turns page text into sections and chunks, retrieves evidence per
governance dimension, verifies citations, derives rule-based verdicts and rolls
them up.  Every operator takes and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# Ship the package's small Python kernels inside the task closure, so executors
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
