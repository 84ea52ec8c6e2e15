"""All queries of this subpackage: importing the modules registers them."""

from concord.llm import (  # noqa: F401
    decontamination,
    embedding_dedup,
    fill_in_middle,
    importance,
    language_id,
    licenses,
    near_dedup,
    packing,
    quality,
    sharding,
    suffix_dedup,
    token_counts,
    warc,
)
from concord.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
