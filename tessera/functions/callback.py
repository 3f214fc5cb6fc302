"""Ordinary Python functions as callbacks of queries, for what Spark's own columns cannot tell.

They run on executors, batch by batch through Arrow, and see one row at a time as a dict. Column lambdas stay
the first choice: Catalyst can look into them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Callback:
    """A function of a row's values, and the type of what it gives."""

    function: Callable[[dict[str, Any]], Any]
    returns: T.DataType

    def column(self, columns: dict[str, Column]) -> Column:
        function = self.function
        test = isinstance(self.returns, T.BooleanType)

        def call(row: Any) -> Any:
            found = function(row.asDict(True))
            return bool(found) if test else found

        return F.udf(call, self.returns, useArrow=True)(F.struct(*[c.alias(k) for k, c in columns.items()]))


def in_python(function: Callable[[dict[str, Any]], Any], returns: T.DataType | str = "boolean") -> Callback:
    """A Python function as a test (the default), or as a projection with the type of its result."""
    return Callback(function, T._parse_datatype_string(returns) if isinstance(returns, str) else returns)
