"""Query registry: key -> builder(spark, sf_dir) -> DataFrame.

Builders read the driver tables through the lens, build the star lazily and
run one analytical job.  Nothing is collected; each call returns a lazy plan
(the NTILEs of the RFM scores are the exception: the person rows are stored
once and their cut rows selected, see mercato.operators.ranking).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mercato.params import FIXTURE_PARAMS, Params
from mercato.session import bound_tasks
from mercato.sources import lens
from mercato.sources.star import Star, build

Builder = Callable[[SparkSession, str], DataFrame]


def star_for(spark: SparkSession, sf_dir: str, p: Params = FIXTURE_PARAMS) -> Star:
    return build(lens.load(spark, sf_dir), p)


REGISTRY: dict[str, Callable[[Star, Params], DataFrame]] = {}


def register(key: str):
    def deco(fn):
        REGISTRY[key] = fn
        return fn

    return deco


def queries(p: Params = FIXTURE_PARAMS) -> dict[str, Builder]:
    # importing the modules fills REGISTRY
    from mercato.plans import catalog  # noqa: F401

    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_tasks(spark)
            return fn(star_for(spark, sf_dir, p), p)

        return run

    return {k: bind(fn) for k, fn in REGISTRY.items()}
