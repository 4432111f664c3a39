"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from tastegrid.llm.bpe import op7_byte_bpe
from tastegrid.llm.classlm import op11_class_lm
from tastegrid.llm.divergence import OP12_SQL, op12_divergence_audit
from tastegrid.llm.jaccard import OP4_SQL, op4_jaccard
from tastegrid.llm.knn import OP9_SQL, op9_exact_topk
from tastegrid.llm.licenses import op10_license_scan
from tastegrid.llm.mixing import op2_mixing
from tastegrid.llm.quality import op1_quality_rules
from tastegrid.llm.repeats import op8_suffix_dedup
from tastegrid.llm.sharding import op5_sharding
from tastegrid.llm.tokencount import op6_token_counts
from tastegrid.llm.triecodes import OP13_SQL, op13_trie_codes
from tastegrid.llm.urls import op3_url_filters

QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_mixing, op3_url_filters, op4_jaccard, op5_sharding,
    op6_token_counts, op7_byte_bpe, op8_suffix_dedup, op9_exact_topk, op10_license_scan,
    op11_class_lm, op12_divergence_audit, op13_trie_codes,
)}
ORACLES: dict[str, str] = {"op4_jaccard": OP4_SQL, "op9_exact_topk": OP9_SQL,
                           "op12_divergence_audit": OP12_SQL, "op13_trie_codes": OP13_SQL}
