"""Imports every module that registers queries."""

from nosoflow.plans import (  # noqa: F401
    evaluation, files, hierarchy, monitoring, pages, quality, reports, sampling, streams, terminology, translation, verification,
)
from nosoflow.plans.registry import ORACLES, QUERIES  # noqa: F401
