"""Operators for preparing language-model training data.

Functions of this package travel to Spark's Python workers with their code, so that the
executors need not have the package installed.
"""

from pyspark import cloudpickle

import ingestctl

cloudpickle.register_pickle_by_value(ingestctl)
