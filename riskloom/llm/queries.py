"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.op1_backoff import op1_backoff
from riskloom.llm.op2_rules import OP2_SQL, op2_rules
from riskloom.llm.op3_slots import OP3_SQL, op3_slots
from riskloom.llm.op4_pu import op4_pu
from riskloom.llm.op5_crf import op5_crf
from riskloom.llm.op6_templates import OP6_SQL, op6_templates
from riskloom.llm.op7_lines import op7_lines
from riskloom.llm.op8_simhash import op8_simhash
from riskloom.llm.op9_tokens import op9_tokens
from riskloom.llm.op10_mixing import OP10_SQL, op10_mixing
from riskloom.llm.op11_wand import OP11_SQL, op11_wand
from riskloom.llm.op12_audit import OP12_SQL, op12_audit
from riskloom.llm.op13_topk import OP13_SQL, op13_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_backoff": op1_backoff,
    "op2_rules": op2_rules,
    "op3_slots": op3_slots,
    "op4_pu": op4_pu,
    "op5_crf": op5_crf,
    "op6_templates": op6_templates,
    "op7_lines": op7_lines,
    "op8_simhash": op8_simhash,
    "op9_tokens": op9_tokens,
    "op10_mixing": op10_mixing,
    "op11_wand": op11_wand,
    "op12_audit": op12_audit,
    "op13_topk": op13_topk,
}
SQL: dict[str, str] = {"op2_rules": OP2_SQL, "op3_slots": OP3_SQL, "op6_templates": OP6_SQL, "op10_mixing": OP10_SQL, "op11_wand": OP11_SQL, "op12_audit": OP12_SQL, "op13_topk": OP13_SQL}
