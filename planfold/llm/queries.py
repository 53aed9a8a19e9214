"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from planfold.llm import alignment, decontaminate, html_text, language, line_dedup, mixing, near_dedup, pii, quality, simhash, token_files, toxicity, whitening

def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_personal_data": pii.op1_personal_data,
    "op2_quality_divergence": quality.op2_quality_divergence,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_language_mixture": language.op9_language_mixture,
    "op10_token_files": token_files.op10_token_files,
    "op11_cross_tokenizer_alignment": alignment.op11_cross_tokenizer_alignment,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_simhash_near_dedup": simhash.op13_simhash_near_dedup,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE_SQL,
}
