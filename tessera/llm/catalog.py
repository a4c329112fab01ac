"""The queries of this package by name, and the SQL that some of them equal."""

from __future__ import annotations

from tessera.llm.bpe import op6_bpe
from tessera.llm.chat import op9_chat
from tessera.llm.decontaminate import OP2_SQL, op2_decontaminate
from tessera.llm.licenses import op10_licenses
from tessera.llm.linededup import OP5_SQL, op5_linededup
from tessera.llm.media import op8_media
from tessera.llm.neardup import op3_neardup
from tessera.llm.quality import op4_quality
from tessera.llm.sharding import op7_sharding
from tessera.llm.wrappers import op1_html

QUERIES = {
    "op1_html": op1_html,
    "op2_decontaminate": op2_decontaminate,
    "op3_neardup": op3_neardup,
    "op4_quality": op4_quality,
    "op5_linededup": op5_linededup,
    "op6_bpe": op6_bpe,
    "op7_sharding": op7_sharding,
    "op8_media": op8_media,
    "op9_chat": op9_chat,
    "op10_licenses": op10_licenses,
}

ORACLES = {"op2_decontaminate": OP2_SQL, "op5_linededup": OP5_SQL}
