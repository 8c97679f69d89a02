"""Corpus analytics on PySpark: files, lines, symbols and edges as DataFrames.

The package ships itself to Python workers by value, so that a cluster needs
no installation step and a driver may run from any working directory.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
