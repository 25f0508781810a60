"""The service's queries and state changes as named tools with JSON arguments and results, for one workspace.

Any transport can serve ``Tools.call``.  What the service refuses comes as ``ToolError`` with its message; arguments
that a tool doesn't take, or of the wrong kind, too.
"""

from __future__ import annotations

import inspect
import json

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from quire.operators.concepts import InvalidConceptError
from quire.operators.plans import PlanCompleteError, UnknownSectionError
from quire.operators.search import InvalidQueryError
from quire.operators.validation import InvalidIdError
from quire.plans.service import NotFoundError, PlanExistsError, ReadingService

# The tools' names, which are the service's.
NAMES = (
    "get_next_section", "get_section", "mark_read", "search", "get_outline", "get_related", "get_context", "get_concept", "annotate_section", "list_documents", "create_plan", "list_plans",
)
REFUSALS = (NotFoundError, PlanExistsError, InvalidIdError, InvalidQueryError, InvalidConceptError, UnknownSectionError, PlanCompleteError, ValueError)


class ToolError(RuntimeError):
    """What a tool could not do, in words for its caller."""


def _plain(result: object) -> object:
    if isinstance(result, DataFrame):
        return [json.loads(row) for row in result.toJSON().toLocalIterator()]
    return {k: _plain(v) for k, v in result.items()} if isinstance(result, dict) else result


class Tools:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.service = ReadingService(spark, root)

    def describe(self) -> dict[str, dict]:
        """Per tool what it does and its arguments: those without a default must be given."""
        out = {}
        for name in NAMES:
            method = getattr(self.service, name)
            arguments = inspect.signature(method).parameters.values()
            out[name] = {"does": inspect.getdoc(method) or name.replace("_", " "), "arguments": {a.name: {"kind": str(a.annotation), "required": a.default is a.empty} for a in arguments}}
        return out

    def call(self, name: str, **arguments: object) -> object:
        """The tool's result as plain lists and dictionaries."""
        if name not in NAMES:
            raise ToolError(f"no tool {name!r}; there are {', '.join(NAMES)}")
        method = getattr(self.service, name)
        try:
            inspect.signature(method).bind(**arguments)
            return _plain(method(**arguments))
        except (*REFUSALS, TypeError) as problem:
            raise ToolError(str(problem)) from problem
        except PySparkException as problem:
            raise ToolError(str(problem).splitlines()[0]) from problem
