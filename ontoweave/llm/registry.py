"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from ontoweave.llm.chat import ORACLE_6, op6_chat
from ontoweave.llm.covertree import ORACLE_10, op10_covertree
from ontoweave.llm.decontaminate import op3_decontaminate
from ontoweave.llm.materialise import op8_training_order
from ontoweave.llm.packing import op5_packing
from ontoweave.llm.quality import op1_quality
from ontoweave.llm.secrets import op9_secrets
from ontoweave.llm.simhash import op7_simhash
from ontoweave.llm.suffixes import op2_suffixes
from ontoweave.llm.warc import ORACLE_4, op4_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_suffixes": op2_suffixes,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_chat": op6_chat,
    "op7_simhash": op7_simhash,
    "op8_training_order": op8_training_order,
    "op9_secrets": op9_secrets,
    "op10_covertree": op10_covertree,
}

ORACLES: dict[str, str] = {
    "op4_warc": ORACLE_4,
    "op6_chat": ORACLE_6,
    "op10_covertree": ORACLE_10,
}
