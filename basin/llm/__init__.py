"""Training-data operators: one module per operator, registered in ``basin.llm.queries``.

Functions that run inside Python tasks are shipped by value, so executors need only the public
packages (numpy, pyarrow, tokenizers, xxhash, regex), not this library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
