"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assetgraph.llm import collocations, licenses, neardup, vptree, warc
from assetgraph.llm.collocations import op13_collocations
from assetgraph.llm.decontaminate import op1_decontaminate
from assetgraph.llm.neardup import op5_minhash
from assetgraph.llm.packing import op10_packing
from assetgraph.llm.pii import op6_pii
from assetgraph.llm.quality import op3_quality
from assetgraph.llm.repeats import op9_repeats
from assetgraph.llm.sharding import op12_sharding
from assetgraph.llm.toxicity import op4_toxicity
from assetgraph.llm.vptree import op2_vptree
from assetgraph.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_vptree": op2_vptree,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_minhash": op5_minhash,
    "op6_pii": op6_pii,
    "op7_licenses": licenses.op7_licenses,
    "op8_warc": warc.op8_warc,
    "op9_repeats": op9_repeats,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_sharding": op12_sharding,
    "op13_collocations": op13_collocations,
}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose results SQL can give exactly."""
    return {"op2_vptree": vptree.ORACLE, "op5_minhash": neardup.ORACLE, "op7_licenses": licenses.oracle(), "op8_warc": warc.ORACLE, "op13_collocations": collocations.ORACLE}
