"""Run one request on a DataFrame."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from .model import ErrorCode, OperatorError, Request, Result
from .plans.registry import lookup
from .plans.validate import prepare

PROTOCOL = "1.0"


def run_operation(df: DataFrame, request: Request) -> Result:
    """Validate, run and check one operator; other failures become EXECUTION_ERROR without details of the machine."""
    if request.context.protocol_version.split(".")[0] != PROTOCOL.split(".")[0]:
        raise OperatorError(ErrorCode.EXECUTION_ERROR, "protocol version is not supported", version=request.context.protocol_version)
    op = lookup(request.operation_key)
    try:
        result = op.run(prepare(op, df, request.slots, request.parameters, request.context))
    except OperatorError:
        raise
    except (PySparkException, ArithmeticError, ValueError, KeyError, IndexError) as e:
        raise OperatorError(ErrorCode.EXECUTION_ERROR, "operator failed", run_id=request.context.run_id, kind=type(e).__name__) from e
    result.metadata.setdefault("operation_key", op.key)
    if result.data is not None:
        names = [c.lower() for c in result.data.columns]
        if len(set(names)) != len(names):
            raise OperatorError(ErrorCode.EXECUTION_ERROR, "result columns repeat a name")
    return result
