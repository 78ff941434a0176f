"""Curation, batch prediction and evaluation of parallel text on PySpark.

Public surface: ``Column -> Column`` functions in ``glossaflow.functions`` and
``DataFrame -> DataFrame`` functions in the other subpackages.
"""

import sys

from pyspark import cloudpickle

# Arrow kernels and predictors are shipped inside the job itself, so executors
# need nothing but Spark, numpy and pyarrow installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
