"""Registry of the queries of this subpackage."""

from __future__ import annotations

from . import (
    collocations, decontamination, html_text, lexical_search, ngram_lm, packing, quality, secret_scan, simhash, token_counts,
    token_shards, toxicity, warc,
)

QUERIES = {
    "op1_token_shards": token_shards.op1_token_shards,
    "op2_html_text": html_text.op2_html_text,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_warc": warc.op5_warc,
    "op6_ngram_lm": ngram_lm.op6_ngram_lm,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE = {"op4_quality_rules": quality.OP4_SQL, "op5_warc": warc.OP5_SQL, "op12_lexical_search": lexical_search.OP12_SQL, "op13_collocations": collocations.OP13_SQL}
