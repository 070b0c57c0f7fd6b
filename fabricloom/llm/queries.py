"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontamination import OP5_SQL, op5_decontamination
from .jaccard import OP9_SQL, op9_jaccard_partition
from .language import op12_crf_language
from .licenses import op2_license_scan
from .negatives import OP11_SQL, op11_hard_negatives
from .packing import op3_histogram_packing
from .pii import op7_feistel_pseudonyms
from .quality import OP4_SQL, op4_quality_cascade
from .search import OP13_SQL, op13_tiered_search
from .sharding import op1_jump_sharding
from .substrings import OP6_SQL, op6_debruijn_substrings
from .suffixes import OP8_SQL, op8_induced_suffixes
from .token_files import op10_token_files


def queries() -> dict:
    return {
        "op1_jump_sharding": op1_jump_sharding,
        "op2_license_scan": op2_license_scan,
        "op3_histogram_packing": op3_histogram_packing,
        "op4_quality_cascade": op4_quality_cascade,
        "op5_decontamination": op5_decontamination,
        "op6_debruijn_substrings": op6_debruijn_substrings,
        "op7_feistel_pseudonyms": op7_feistel_pseudonyms,
        "op8_induced_suffixes": op8_induced_suffixes,
        "op9_jaccard_partition": op9_jaccard_partition,
        "op10_token_files": op10_token_files,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_crf_language": op12_crf_language,
        "op13_tiered_search": op13_tiered_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_cascade": OP4_SQL,
        "op5_decontamination": OP5_SQL,
        "op6_debruijn_substrings": OP6_SQL,
        "op8_induced_suffixes": OP8_SQL,
        "op9_jaccard_partition": OP9_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op13_tiered_search": OP13_SQL,
    }
