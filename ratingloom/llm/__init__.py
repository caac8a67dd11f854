"""Operators that prepare training data: filters, deduplication, tokens, packing, search and archives.

Code that runs in Python workers is shipped with the job, so executors need no copy of this subpackage.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
