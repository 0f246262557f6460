"""Analytics for source-code repositories on Spark: scanning, parsing, graphs, rules, patches and retrieval."""

import os
import sys

__version__ = "0.1.0"

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    # Python workers may not find this package: send its functions by value.
    from pyspark.cloudpickle import register_pickle_by_value

    register_pickle_by_value(sys.modules[__name__])
