"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import mixing, rollup, substrings, vector_dedup, vptree
from .langid import op6_langid
from .mixing import op8_mixing
from .pieces import op10_sentencepiece
from .quality import op4_quality
from .rollup import op9_token_rollup, word_rollup
from .simhash import op5_simhash
from .substrings import op7_substrings
from .token_files import op2_token_files
from .vector_dedup import op1_vector_dedup
from .vptree import op3_vptree


def queries() -> dict:
    return {f.__name__: f for f in (op1_vector_dedup, op2_token_files, op3_vptree, op4_quality, op5_simhash, op6_langid, op7_substrings, op8_mixing, op9_token_rollup, op10_sentencepiece, word_rollup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_vector_dedup": vector_dedup.ORACLE, "op7_substrings": substrings.ORACLE, "op3_vptree": vptree.ORACLE, "op8_mixing": mixing.ORACLE, "word_rollup": rollup.ORACLE}
