"""The opN_ queries and, where DuckDB can say the same, their SQL."""

from __future__ import annotations

from bookloom.llm.chat import OP4_SQL, op4_chat_format
from bookloom.llm.decontaminate import OP2_SQL, op2_decontamination
from bookloom.llm.langid import op5_language_id
from bookloom.llm.licenses import OP1_SQL, op1_license_scan
from bookloom.llm.media import op8_media
from bookloom.llm.minhash import OP10_SQL, op10_minhash
from bookloom.llm.mixing import op7_mixing
from bookloom.llm.repair import OP13_SQL, op13_conversation_repair
from bookloom.llm.search import OP12_SQL, op12_ranked_search
from bookloom.llm.sharding import op3_sharding
from bookloom.llm.simhash import op11_simhash
from bookloom.llm.substring import OP9_SQL, op9_substring
from bookloom.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_decontamination, op3_sharding, op4_chat_format, op5_language_id, op6_toxicity, op7_mixing, op8_media, op9_substring,
    op10_minhash, op11_simhash, op12_ranked_search, op13_conversation_repair)}
ORACLES = {name: sql.strip() for name, sql in {
    "op1_license_scan": OP1_SQL, "op2_decontamination": OP2_SQL, "op4_chat_format": OP4_SQL, "op9_substring": OP9_SQL, "op10_minhash": OP10_SQL,
    "op12_ranked_search": OP12_SQL, "op13_conversation_repair": OP13_SQL}.items()}
