"""Queries of this subpackage and the SQL that checks them where SQL can."""

from __future__ import annotations

from . import align, collocations, decontaminate, hmm, html_extract, itq, langid, packing, secret_scan, simhash, suffix_dedup, token_store, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_token_store": token_store.query,
    "op3_hmm": hmm.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_packing": packing.query,
    "op6_itq": itq.query,
    "op7_langid": langid.query,
    "op8_decontaminate": decontaminate.query,
    "op9_simhash": simhash.query,
    "op10_secret_scan": secret_scan.query,
    "op11_align": align.query,
    "op12_html_extract": html_extract.query,
    "op13_collocations": collocations.query,
}

ORACLE_SQL: dict[str, str] = {"op13_collocations": collocations.SQL}
