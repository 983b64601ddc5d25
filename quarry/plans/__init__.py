"""Named queries over the driver tables (each with a DuckDB oracle where SQL can express it)."""

from quarry.plans.registry import REGISTRY, query  # noqa: F401
from quarry.plans import q_profile  # noqa: F401
from quarry.plans import q_clean  # noqa: F401,E402
from quarry.plans import q_charts  # noqa: F401,E402
from quarry.plans import q_models  # noqa: F401,E402
from quarry.plans import q_sources  # noqa: F401,E402
