"""The registered queries of the training-data operators."""

from strandline.llm.decontaminate import op10_seed_align
from strandline.llm.language_model import op8_pitman_yor
from strandline.llm.lexical import OP12_SQL, op12_geometric_blocks
from strandline.llm.media import op5_progressive_jpeg
from strandline.llm.near_dedup import OP2_SQL, op2_lsh_forest
from strandline.llm.packing import op1_best_fit
from strandline.llm.quality import op6_line_field
from strandline.llm.secrets import op4_tag_field
from strandline.llm.sharding import op13_virtual_slots
from strandline.llm.substrings import OP9_SQL, op9_seed_extend
from strandline.llm.token_alignment import op11_space_anchors
from strandline.llm.token_store import op7_token_planes
from strandline.llm.toxicity import op3_factorization

QUERIES = {f.__name__: f for f in (op1_best_fit, op2_lsh_forest, op3_factorization, op4_tag_field, op5_progressive_jpeg, op6_line_field, op7_token_planes, op8_pitman_yor, op9_seed_extend, op10_seed_align, op11_space_anchors, op12_geometric_blocks, op13_virtual_slots)}
ORACLE = {"op2_lsh_forest": OP2_SQL, "op9_seed_extend": OP9_SQL, "op12_geometric_blocks": OP12_SQL}
