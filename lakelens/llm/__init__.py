"""Operators of a training-data pipeline: token counts, sharding, exact, near
and substring deduplication, decontamination, toxicity, language-model scoring,
packing, web archives, whitening of embeddings and collocations.

Nothing outside this package imports it.  The code that runs in Python workers
is pickled by value, so executors need the third-party libraries but not this
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
