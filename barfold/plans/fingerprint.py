"""What a run was made from, as short hashes: stored results are reused only under the same ones."""

import functools
import hashlib
from types import CodeType
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest(*parts: Any) -> str:
    return hashlib.sha256("\x1f".join(map(_told, parts)).encode()).hexdigest()[:24]


def _told(part: Any) -> str:
    """A text that differs where the part does and does not hold addresses."""
    if isinstance(part, functools.partial):
        return f"partial({_told(part.func)},{_told(part.args)},{_told(part.keywords)})"
    if isinstance(part, CodeType):
        return f"code({part.co_code.hex()},{_told(part.co_consts)},{part.co_names},{part.co_varnames})"
    if hasattr(part, "__code__"):
        cells = [c.cell_contents for c in part.__closure__ or ()]
        return (f"function({part.__module__},{part.__qualname__},{_told(part.__code__)},{_told(part.__defaults__)},"
                f"{_told(part.__kwdefaults__)},{_told(cells)})")
    if isinstance(part, dict):
        return "{" + ",".join(f"{_told(k)}:{_told(part[k])}" for k in sorted(part, key=repr)) + "}"
    if isinstance(part, (list, tuple)):
        return "[" + ",".join(map(_told, part)) + "]"
    if isinstance(part, (set, frozenset)):
        return "{" + ",".join(sorted(map(_told, part))) + "}"
    if callable(part) and hasattr(part, "__dict__") and not isinstance(part, type):
        return f"object({type(part).__module__},{type(part).__qualname__},{_told(vars(part))})"
    return repr(part)


def of_table(df: DataFrame | None) -> str:
    """Hash of a table's columns and rows, whatever their order: one aggregate over it, one row to the driver."""
    if df is None:
        return "none"
    row = F.struct(*df.columns)
    # Two sums of differently seeded row hashes; equal rows count as often as they occur.
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")) for seed in (1, 2)]
    return digest(df.dtypes, *df.agg(F.count(F.lit(1)), *sums).first())
