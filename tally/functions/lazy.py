"""UDFs that need no session when their module is imported."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def udf(schema: str, vectorised: bool = False):
    """Decorator: F.udf or F.pandas_udf, built at the first use."""

    def wrap(f):
        built = []

        @functools.wraps(f)
        def call(*columns):
            if not built:
                built.append(F.pandas_udf(f, schema) if vectorised else F.udf(f, schema))
            return built[0](*columns)

        return call

    return wrap
