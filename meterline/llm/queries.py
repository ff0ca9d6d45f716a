"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from meterline.llm.alignment import op11_alignment
from meterline.llm.conversations import ORACLE_OP13, op13_conversation_repair
from meterline.llm.ctw import op10_lm_scores
from meterline.llm.media import op8_media
from meterline.llm.minhash import op2_fingerprints
from meterline.llm.mixing import ORACLE_OP4, op4_mixing
from meterline.llm.packing import op7_packing
from meterline.llm.passages import op3_passages
from meterline.llm.secrets import op6_secrets
from meterline.llm.sharding import ORACLE_OP12, op12_sharding
from meterline.llm.simhash import op5_simhash
from meterline.llm.tokens import op9_token_shards
from meterline.llm.toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_fingerprints, op3_passages, op4_mixing, op5_simhash, op6_secrets, op7_packing, op8_media, op9_token_shards, op10_lm_scores, op11_alignment, op12_sharding, op13_conversation_repair)
}
ORACLES = {"op4_mixing": ORACLE_OP4, "op12_sharding": ORACLE_OP12, "op13_conversation_repair": ORACLE_OP13}
