"""The queries of this subpackage and, where SQL can express them, their SQL."""

from .exact_dedup import OP2_SQL, op2_golomb_exchange
from .licenses import op3_dice_licenses
from .packing import op9_sum_of_squares
from .pii import op6_weak_supervision
from .quality import op10_additive_model
from .sampling import op7_gumbel_top_k
from .sharding import op1_rendezvous
from .simhash import op8_simhash
from .tiff import op5_tiff
from .warc import OP4_SQL, op4_salvage

QUERIES = {
    "op1_rendezvous": op1_rendezvous,
    "op2_golomb_exchange": op2_golomb_exchange,
    "op3_dice_licenses": op3_dice_licenses,
    "op4_salvage": op4_salvage,
    "op5_tiff": op5_tiff,
    "op6_weak_supervision": op6_weak_supervision,
    "op7_gumbel_top_k": op7_gumbel_top_k,
    "op8_simhash": op8_simhash,
    "op9_sum_of_squares": op9_sum_of_squares,
    "op10_additive_model": op10_additive_model,
}

SQL = {"op2_golomb_exchange": OP2_SQL, "op4_salvage": OP4_SQL}
