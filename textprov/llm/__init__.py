"""Training-data operators: quality, licences, duplicates, benchmarks, mixing, chat and archives.

Functions of this subpackage travel to tasks by value, so executors need numpy, pyarrow
and the libraries an operator names, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
