"""Named queries over the test tables, each with its DuckDB oracle SQL where SQL can express it."""

from quarry.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
from quarry.plans import relational, text, clones, corpus  # noqa: F401  (register queries)
