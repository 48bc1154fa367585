"""All registered queries of the comment-integrity operators and their SQL."""

from tidewatch.plans import analysis, landing, relational, streams  # noqa: F401
from tidewatch.plans.registered import ORACLE_SQL, QUERIES  # noqa: F401
