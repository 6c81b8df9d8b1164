"""The queries of this package, and the SQL they are checked by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_alignment
from .decontam import op1_decontamination
from .fingerprints import op9_fingerprints
from .htmltext import op4_html_text
from .langid import op10_language
from .mixing import op8_mixing
from .neardup import OP3_SQL, op3_minhash
from .quality import op2_quality
from .runs import op13_runs
from .secrets import op5_secrets
from .setjoin import OP11_SQL, op11_jaccard
from .toxicity import op6_toxicity
from .warc import OP7_SQL, op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_minhash": op3_minhash,
    "op4_html_text": op4_html_text,
    "op5_secrets": op5_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_fingerprints": op9_fingerprints,
    "op10_language": op10_language,
    "op11_jaccard": op11_jaccard,
    "op12_alignment": op12_alignment,
    "op13_runs": op13_runs,
}

# The others train, sketch, parse or take texts apart in ways SQL has no words for.
ORACLE_SQL: dict[str, str] = {
    "op3_minhash": OP3_SQL,
    "op7_warc": OP7_SQL,
    "op11_jaccard": OP11_SQL,
}
