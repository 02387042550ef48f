"""Spark jobs that prepare, check, export and score tool-call and JSON-mode conversations.

The layers, from the inside out:

* ``functions``  Column expressions (text, JSON, messages, tools). No DataFrames, no Python workers.
* ``operators``  ``DataFrame -> DataFrame`` steps: packing, retrieval, validation, scoring, ...
* ``sources``    scans and sinks.
* ``plans``      whole jobs built from the operators.
* ``streaming``  the incremental example index.
* ``catalog``    the registered queries and the SQL each is checked against.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
