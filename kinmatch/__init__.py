"""Record linkage on Spark DataFrames.

Functions handed to Spark's Python workers, and objects that operators
broadcast, are pickled with their code, so a cluster needs no copy of this
package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
