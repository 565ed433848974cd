"""The registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from .bpe_dp import op8_bpe_codec
from .decontaminate import op7_template_decontamination
from .html_paths import op4_html_paths
from .kn_language import op9_language_kn
from .license_join import op2_license_join, op2_sql
from .near_jaccard import op6_near_jaccard
from .pii_feistel import op1_pii_pseudonyms
from .quality_mcd import op3_quality_mcd
from .quality_ri import op5_quality_ri
from .token_sst import op10_token_sst

QUERIES = {
    "op1_pii_pseudonyms": op1_pii_pseudonyms,
    "op2_license_join": op2_license_join,
    "op3_quality_mcd": op3_quality_mcd,
    "op4_html_paths": op4_html_paths,
    "op5_quality_ri": op5_quality_ri,
    "op6_near_jaccard": op6_near_jaccard,
    "op7_template_decontamination": op7_template_decontamination,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_language_kn": op9_language_kn,
    "op10_token_sst": op10_token_sst,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_join": op2_sql(),
}
