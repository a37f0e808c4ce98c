"""Research-paper tables on Spark.

Paper pages, page text of documents, citation catalogs and service answers go
in as DataFrames and come out as DataFrames; Catalyst plans the work.
"""

import sys

from pyspark import cloudpickle

# Functions handed to Spark travel with their code, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
