"""Pandas UDFs that are made when first used, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class LazyUDF:
    def __init__(self, function: Callable, kind: str):
        self.function, self.kind, self._udf = function, kind, None
        self.__doc__ = function.__doc__

    @property
    def udf(self):
        if self._udf is None:
            self._udf = F.pandas_udf(self.function, self.kind)
        return self._udf

    def __call__(self, *columns) -> Column:
        return self.udf(*columns)


def pandas_udf(kind: str) -> Callable[[Callable], LazyUDF]:
    return lambda function: LazyUDF(function, kind)
