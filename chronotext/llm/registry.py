"""The subpackage's queries, and their SQL where SQL can express them."""

from .chat_tree import OP3_SQL, op3_prefix_tree_chat
from .decontaminate import op4_template_decontamination
from .importance import op1_importance_resampling
from .licenses import op6_license_classifier
from .packing import op7_pattern_packing
from .pii import op2_skip_chain_pii
from .quality_rules import OP5_SQL, op5_rule_cascade
from .repair_codec import op9_repair_tokens
from .simhash import op10_simhash_vptree
from .tier_packing import op12_tier_packing
from .turn_repair import OP13_SQL, op13_turn_repair
from .warc import OP8_SQL, op8_warc_zstd
from .whitening import op11_compensated_whitening

QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_skip_chain_pii": op2_skip_chain_pii,
    "op3_prefix_tree_chat": op3_prefix_tree_chat,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_rule_cascade": op5_rule_cascade,
    "op6_license_classifier": op6_license_classifier,
    "op7_pattern_packing": op7_pattern_packing,
    "op8_warc_zstd": op8_warc_zstd,
    "op9_repair_tokens": op9_repair_tokens,
    "op10_simhash_vptree": op10_simhash_vptree,
    "op11_compensated_whitening": op11_compensated_whitening,
    "op12_tier_packing": op12_tier_packing,
    "op13_turn_repair": op13_turn_repair,
}
ORACLES: dict[str, str] = {
    "op3_prefix_tree_chat": OP3_SQL,
    "op5_rule_cascade": OP5_SQL,
    "op8_warc_zstd": OP8_SQL,
    "op13_turn_repair": OP13_SQL,
}
