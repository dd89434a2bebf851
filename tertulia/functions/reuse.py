"""Reuse of large column expressions.

An expression over many rules takes seconds to put together from Python and is
the same for every table, so it is built once per Spark application.
"""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession


def once_per_application(build):
    made: dict = {}

    @functools.wraps(build)
    def get(*args):
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]

    return get
