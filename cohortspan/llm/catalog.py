"""Registered queries of the subpackage; importing the operators registers them."""

from cohortspan.llm import (  # noqa: F401
    byte_bpe,
    chat_format,
    collocations,
    decontamination,
    lexical_search,
    line_dedup,
    lm_scoring,
    minhash_dedup,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    token_counts,
    warc,
)
from cohortspan.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
