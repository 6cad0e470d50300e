"""All registered queries of the subpackage."""

from sparquill.llm import (  # noqa: F401
    alignment,
    conversations,
    exact_dedup,
    license_scan,
    line_dedup,
    near_dedup,
    neighbours,
    packing,
    quality,
    secret_scan,
    sharding,
    source_mix,
    toxicity,
)
from sparquill.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
