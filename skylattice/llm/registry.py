"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, exact_dedup, jaccard, licenses, packing, pii, secrets, toxicity, warc, wavelet

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_wavelet_tokens": wavelet.op7_wavelet_tokens,
    "op8_warc_zip": warc.op8_warc_zip,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLE_SQL = {"op2_exact_dedup": exact_dedup.ORACLE, "op10_decontamination": decontaminate.ORACLE}
