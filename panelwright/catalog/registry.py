"""Name → (Spark query, DuckDB oracle SQL) registry.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame.  Doubles are
rounded on both sides before comparison: ``digits`` for the Spark result, and
the same ``round`` applied to the listed ``doubles`` in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import round_doubles


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    digits: int = 6
    doubles: dict = field(default_factory=dict)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.doubles:
            return self.sql
        # "+ 0.0" turns a rounded -0.0 into 0.0 (same on the Spark side)
        rep = ", ".join(f'{_sql_round(c, d)} AS "{c}"' for c, d in self.doubles.items())
        return f"SELECT * REPLACE ({rep}) FROM (\n{self.sql}\n) AS oracle_q"


def _sql_round(c: str, d) -> str:
    """DuckDB text of ``functions.exprs._round_one``."""
    if isinstance(d, str) and d.startswith("sig"):
        n = int(d[3:])
        k = f'(floor(log10(abs("{c}"))) - {n - 1})'
        return (f'CASE WHEN "{c}" IS NULL OR "{c}" = 0 THEN "{c}" + 0.0 ELSE (CASE WHEN {k} >= 0 '
                f'THEN round("{c}" / pow(10.0, {k})) * pow(10.0, {k}) '
                f'ELSE round("{c}" * pow(10.0, -{k})) / pow(10.0, -{k}) END) + 0.0 END')
    return f'round("{c}", {d}) + 0.0'


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, doubles: Sequence[str] | dict = (), digits: int = 6):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``doubles``: the DOUBLE output columns, as a list (all at ``digits``) or a
    dict column → digits (an int, or ``"sigN"`` for N significant digits).
    """
    dmap = dict(doubles) if isinstance(doubles, dict) else {c: digits for c in doubles}

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), digits, dmap)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, run, sql, digits, dmap)
        return fn
    return deco
