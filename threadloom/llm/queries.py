"""Queries of this subpackage for the driver contract."""

from __future__ import annotations

from .chat import OP3_SQL, op3_prefix_targets
from .jaccard import OP5_SQL, op5_signature_tree_jaccard
from .langid import op8_compression_language
from .lexical import OP13_SQL, op13_block_max_search
from .merkle import OP11_SQL, op11_merkle_manifest
from .mixing import op12_source_mix
from .packing import op10_exact_complement_packing
from .pieces import op7_shared_prefix_viterbi
from .repetition import OP2_SQL, op2_repetition_coverage
from .substring import OP6_SQL, op6_count_min_substrings
from .token_shards import op1_bit_plane_shards
from .topk import OP4_SQL, op4_columnar_top_k
from .wrapper import op9_wrapper_induction

QUERIES = {f.__name__: f for f in (op1_bit_plane_shards, op2_repetition_coverage, op3_prefix_targets, op4_columnar_top_k, op5_signature_tree_jaccard, op6_count_min_substrings, op7_shared_prefix_viterbi, op8_compression_language, op9_wrapper_induction, op10_exact_complement_packing, op11_merkle_manifest, op12_source_mix, op13_block_max_search)}
ORACLE_SQL: dict[str, str] = {"op2_repetition_coverage": OP2_SQL, "op3_prefix_targets": OP3_SQL, "op4_columnar_top_k": OP4_SQL, "op5_signature_tree_jaccard": OP5_SQL, "op6_count_min_substrings": OP6_SQL, "op11_merkle_manifest": OP11_SQL, "op13_block_max_search": OP13_SQL}
