"""Python functions of this package travel to the executors by value.

Importing this module is enough. Executors then need neither the package installed nor
``--py-files``, wherever the driver found it.
"""

from pyspark import cloudpickle

import prefmill

cloudpickle.register_pickle_by_value(prefmill)
