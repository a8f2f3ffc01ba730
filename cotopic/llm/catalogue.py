"""The registered queries of the subpackage and their SQL."""

from cotopic.llm.hostrules import OP4_SQL, op4_host_rules
from cotopic.llm.langid import op10_language
from cotopic.llm.linedup import OP7_SQL, op7_line_dedup
from cotopic.llm.mixing import OP8_SQL, op8_mixing
from cotopic.llm.packing import op9_packing
from cotopic.llm.pagetemplate import op12_html_extraction
from cotopic.llm.prefixtrie import OP11_SQL, op11_prefix_trie
from cotopic.llm.simhash import op5_simhash
from cotopic.llm.spelling import OP13_SQL, op13_spelling
from cotopic.llm.suffix_dedup import op3_suffix_dedup
from cotopic.llm.tokens import op6_token_counts
from cotopic.llm.toxicity import op1_toxicity
from cotopic.llm.vafile import OP2_SQL, op2_top_k

QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_top_k, op3_suffix_dedup, op4_host_rules, op5_simhash, op6_token_counts, op7_line_dedup,
    op8_mixing, op9_packing, op10_language, op11_prefix_trie,
    op12_html_extraction, op13_spelling)}

#: What SQL can express; the others are tested against plain versions in tests/llm.
ORACLE = {"op2_top_k": OP2_SQL, "op4_host_rules": OP4_SQL, "op7_line_dedup": OP7_SQL, "op8_mixing": OP8_SQL,
          "op11_prefix_trie": OP11_SQL, "op13_spelling": OP13_SQL}
