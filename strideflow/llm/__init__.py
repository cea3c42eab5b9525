"""Training-data operators: quality voting, decontamination, token rollups,
packing, similarity join, language id, secret scans, exact dedup, chat
formatting and repeated-byte removal.

Nothing outside this subpackage imports it.  Functions that run in Python
workers are pickled by value, so executors need only the public libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
