"""All queries of the library outside the text operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.plans import dataset, evidence, files, guard, history, links, mails, names, pages, redirects, training, urls
from vigil.streaming import labels

_MODULES = (urls, history, dataset, evidence, files, pages, mails, links, training, guard, redirects, names, labels)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: sql for m in _MODULES for k, sql in m.ORACLE.items()}
