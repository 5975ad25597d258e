"""Training-data operators: ten corpus operators and the helpers they share.

Nothing else in the library imports this package.  Its worker functions are
pickled by value, so executors need pyspark, pyarrow and numpy but no install of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
