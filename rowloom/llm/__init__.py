"""Training-data operators: filtering, deduplication, mixing, scoring and encoding of text.

Nothing else in the library imports this subpackage. Its functions are shipped to
executors by value, so a cluster needs no copy of the repository on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
