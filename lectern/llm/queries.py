"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from lectern.llm import (alignment, decontam, hard_negatives, html_text, lang_id, licenses, near_dup, neighbours, packing,
                         pii, secrets, token_counts, url_rules)

QUERIES = {
    "op1_decontamination": decontam.query,
    "op5_order_minhash": near_dup.query,
    "op2_html_text": html_text.query,
    "op3_packing": packing.query,
    "op4_token_counts": token_counts.query,
    "op8_pii": pii.query,
    "op6_licenses": licenses.query,
    "op7_language_id": lang_id.query,
    "op9_url_rules": url_rules.query,
    "op10_neighbours": neighbours.query,
    "op11_token_alignment": alignment.query,
    "op12_secrets": secrets.query,
    "op13_hard_negatives": hard_negatives.query,
}
ORACLES: dict[str, str] = {"op13_hard_negatives": hard_negatives.SQL}
