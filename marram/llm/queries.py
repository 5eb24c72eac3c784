"""The queries of this package, by name."""

from __future__ import annotations

from . import bpe, centroids, html, language, leaks, licences, quality, repeats, similar, urls, variants, warc, windows

QUERIES = {
    "op1_license_scans": licences.op1_license_scans,
    "op2_warc": warc.op2_warc,
    "op3_html_extraction": html.op3_html_extraction,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_url_filters": urls.op5_url_filters,
    "op6_suffix_dedup": repeats.op6_suffix_dedup,
    "op7_benchmark_decontamination": leaks.op7_benchmark_decontamination,
    "op8_language_id": language.op8_language_id,
    "op9_ngram_jaccard": similar.op9_ngram_jaccard,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_substring_dedup": windows.op13_substring_dedup,
}

#: The method of each operator goes beyond what SQL states, but for those listed here.
ORACLES: dict[str, str] = {"op1_license_scans": licences.OP1_SQL, "op2_warc": warc.OP2_SQL, "op5_url_filters": urls.OP5_SQL, "op11_centroid_clustering": centroids.OP11_SQL}
