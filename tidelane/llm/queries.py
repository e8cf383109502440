"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelane.llm.alignment import op12_alignment
from tidelane.llm.chain_dedup import op6_chain_dedup
from tidelane.llm.decontamination import OP2_SQL, op2_decontamination
from tidelane.llm.jaccard_join import OP3_SQL, op3_jaccard_join
from tidelane.llm.mixing import OP1_SQL, op1_mixing
from tidelane.llm.packing import op11_packing
from tidelane.llm.quality_lm import op5_quality_lm
from tidelane.llm.quality_rules import op4_quality_rules
from tidelane.llm.sharding import op10_sharding
from tidelane.llm.suffix_dedup import op8_suffix_dedup
from tidelane.llm.toxicity import op7_toxicity
from tidelane.llm.warc import OP9_SQL, op9_warc_revisits
from tidelane.llm.whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_lm": op5_quality_lm,
    "op6_chain_dedup": op6_chain_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_sharding": op10_sharding,
    "op11_packing": op11_packing,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1_SQL, "op2_decontamination": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op9_warc_revisits": OP9_SQL}
