"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from terrasol.llm.decontamination import OP2_SQL, op2_decontamination
from terrasol.llm.html_text import op4_html_text
from terrasol.llm.language_model import op5_language_model
from terrasol.llm.license_scan import op13_license_scan
from terrasol.llm.line_dedup import op3_line_dedup
from terrasol.llm.merkle import OP11_SQL, op11_merkle_manifest
from terrasol.llm.near_duplicates import op8_near_duplicates
from terrasol.llm.neighbours import OP6_SQL, op6_nearest
from terrasol.llm.personal_data import op1_personal_data
from terrasol.llm.quality import op7_quality
from terrasol.llm.secret_scan import op9_secret_scan
from terrasol.llm.sentencepieces import op10_sentencepieces
from terrasol.llm.whitening import op12_whitening


def queries() -> dict:
    return {f.__name__: f for f in (op1_personal_data, op2_decontamination, op3_line_dedup, op4_html_text, op5_language_model, op6_nearest, op7_quality, op8_near_duplicates, op9_secret_scan, op10_sentencepieces, op11_merkle_manifest, op12_whitening, op13_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op6_nearest": OP6_SQL, "op11_merkle_manifest": OP11_SQL}
