"""Training-data operators: thirteen corpus operators and the queries that apply them.

Nothing else in the library imports this subpackage. Its task functions travel to the executors by
value, so executors need the Python packages they use but not this library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
