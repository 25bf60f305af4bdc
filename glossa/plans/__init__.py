"""Query catalog. Importing this package registers every named query."""

from glossa.plans import (  # noqa: F401
    label_plans,
    text_plans,
    model_plans,
    prep_plans,
    analysis_plans,
    report_plans,
    stream_plans,
    udf_plans,
)
from glossa.plans.registry import REGISTRY  # noqa: F401
