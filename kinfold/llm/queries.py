"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from .bpe_chunks import op6_bpe_chunks
from .decontamination import op2_decontamination
from .language_id import op3_language_id
from .pii import op1_pii_surrogates
from .quality import op8_quality_rules
from .sharding import op7_sampled_shards
from .simhash_dedup import op10_simhash_dedup
from .token_counts import op9_token_counts
from .token_files import op5_token_files
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_token_files": op5_token_files,
    "op6_bpe_chunks": op6_bpe_chunks,
    "op7_sampled_shards": op7_sampled_shards,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_dedup": op10_simhash_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op4_warc": OP4_SQL,
}
