"""Training-data operators: mixing, filtering, deduplication, search, scoring and token files.

Nothing else in the library imports this subpackage. Task code is shipped to the executors by
value, so they need the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
