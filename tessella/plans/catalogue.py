"""All queries and their SQL twins, by name."""

from . import composites, core, more, summaries  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES  # noqa: F401
