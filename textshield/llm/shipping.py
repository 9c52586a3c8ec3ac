"""Sending objects of bounded size to the tasks."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def ship(spark: SparkSession, thing):
    """A function that gives ``thing`` inside a task; executors need no copy of the package."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(shared.value)
