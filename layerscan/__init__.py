"""layerscan: defect analytics over layered thermal tile images, on PySpark."""

import sys

from pyspark import cloudpickle

# Executors then need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
