"""Every query of the catalog: its Spark form, its inventory ids and the SQL that checks it, side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Run
    sql: str | None


_found: dict[str, Query] = {}
#: Modules that register queries when imported.
MODULES: tuple[str, ...] = ("quillstone.plans.duplicates", "quillstone.plans.catalog", "quillstone.plans.texts", "quillstone.plans.numbers", "quillstone.plans.shelf", "quillstone.plans.streams", "quillstone.plans.stores")


def query(covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def keep(run: Run) -> Run:
        if run.__name__ in _found:
            raise ValueError(f"two queries named {run.__name__}")
        _found[run.__name__] = Query(run.__name__, covers, run, sql)
        return run

    return keep


def all_queries() -> dict[str, Query]:
    for name in MODULES:
        import_module(name)
    return dict(_found)


def queries() -> dict[str, Run]:
    return {k: q.run for k, q in all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in all_queries().items() if q.sql}
