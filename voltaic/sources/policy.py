"""What happens when an input is missing or malformed: the last good output stays, or the run fails."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from . import versions

_LOG = logging.getLogger(__name__)


def refreshed(spark: SparkSession, build: Callable[[], DataFrame], path: str, strict: bool = False) -> DataFrame:
    """The table at path (see versions), replaced by build()'s rows once all of them are written.

    An input that isn't there leaves the last good table and a warning; with strict, or without such a table, it fails.
    Malformed input always fails (SchemaError, ValueError, errors of tasks), and leaves the table as it was. A run that
    dies at any step leaves the table as it was, or as it should be.
    """
    try:
        version = versions.stage(build(), path)
    except AnalysisException as e:
        if strict or e.getCondition() != "PATH_NOT_FOUND":
            raise
        try:
            last = versions.current(spark, path)
        except AnalysisException:
            raise e from None
        _LOG.warning("%s keeps its last good rows: %s", path, e)
        return last
    versions.commit(spark, path, version)
    return versions.current(spark, path)
