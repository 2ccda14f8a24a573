"""Spark-first analytics for code-vulnerability triage."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
