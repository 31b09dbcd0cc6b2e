"""All registered queries; importing this module fills the registry."""

from verdictlake.plans import (  # noqa: F401
    q_compare,
    q_rank,
    q_reports,
    q_stream,
    q_turns,
    q_web,
)
from verdictlake.plans.registry import ORACLES, QUERIES, SURVEY_IDS  # noqa: F401
