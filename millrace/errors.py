"""Configuration errors raised before any job is started."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


class ConfigError(ValueError):
    """A step was given unusable settings; ``code`` is a stable identifier."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def need(condition: bool, code: str, message: str) -> None:
    if not condition:
        raise ConfigError(code, message)


def need_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Resolve names against the schema without reading data."""
    names = list(names)
    known = {c.lower() for c in df.columns}
    missing = [n for n in names if n.split(".")[0].lower() not in known]
    need(not missing, "UNKNOWN_COLUMN", f"columns not in input: {missing}")
    return names
