"""Operators for preparing text at corpus scale: tokens, languages, archives, filters, joins and mixes.

Nothing else in the library imports this subpackage. Words are runs of `[^\\x20\\x09-\\x0D]` throughout.
Functions that run in Python workers travel with the job, so that executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
