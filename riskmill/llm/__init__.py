"""Training-data operators over the tables documents, pages and labels. Nothing outside this package imports it.

Their Python code travels with the tasks, so executors need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
