"""Engine settings: ``spark.tessella.<name>`` of the session, else ``TESSELLA_<NAME>`` of the environment, else a default."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings and their defaults; a default's type is the setting's.
DEFAULTS: dict[str, bool | int | float | str] = {"density_factor": 1.0, "cut_every": 4, "table_codec": "zstd"}
_TRUE = ("1", "true", "yes", "y", "on")


def get(spark: SparkSession, name: str) -> bool | int | float | str:
    if name not in DEFAULTS:
        raise KeyError(f"unknown setting {name!r}; one of {sorted(DEFAULTS)}")
    default = DEFAULTS[name]
    raw = spark.conf.get(f"spark.tessella.{name}", None) or os.environ.get(f"TESSELLA_{name.upper()}")
    if raw is None:
        return default
    return raw.strip().lower() in _TRUE if isinstance(default, bool) else type(default)(raw)
