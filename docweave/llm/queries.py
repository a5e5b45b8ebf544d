"""Queries of this subpackage and the SQL that some of them are compared with."""

from __future__ import annotations

import corpus_pipeline

from .ballcodes import OP11_SQL, op11_codes
from .decontaminate import OP3_SQL, op3_decontaminate
from .jaccard import OP8_SQL, op8_jaccard
from .langid import op1_language
from .licenses import op10_license
from .mixing import op13_mixing
from .pieces import op6_pieces
from .pii import op9_pii
from .quality import op7_quality
from .topk import OP5_SQL, op5_topk
from .toxicity import op2_toxicity
from .turns import OP12_SQL, op12_turns
from .warc import OP4_SQL, op4_warc

QUERIES = {"op1_language": op1_language, "op2_toxicity": op2_toxicity, "op3_decontaminate": op3_decontaminate, "op4_warc": op4_warc, "op5_topk": op5_topk, "op6_pieces": op6_pieces, "op7_quality": op7_quality, "op8_jaccard": op8_jaccard, "op9_pii": op9_pii, "op10_license": op10_license, "op11_codes": op11_codes, "op12_turns": op12_turns, "op13_mixing": op13_mixing, "pipeline": corpus_pipeline.run}
ORACLES = {"op3_decontaminate": OP3_SQL, "op4_warc": OP4_SQL, "op5_topk": OP5_SQL, "op8_jaccard": OP8_SQL, "op11_codes": OP11_SQL, "op12_turns": OP12_SQL}
