"""All registered queries."""

from . import (  # noqa: F401
    aggregates,
    columns,
    filters,
    functions,
    history,
    joins,
    mart,
    modeling,
    nested,
    privacy,
    quality,
    sets,
    sources,
    streams,
    timecal,
    windows,
)
from .registry import ORACLES, QUERIES  # noqa: F401
