"""All registered queries outside the training-data operators."""

from tidepanel.plans import combined, daily, forecasts, panel, reports, research, variants  # noqa: F401
from tidepanel.plans.registry import QUERIES, all_sql  # noqa: F401
