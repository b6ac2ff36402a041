"""The registered query of each operator, and the SQL of those that SQL can express."""

from scriptorium.llm import centroids, chat, decontam, jaccard, licenses, lines, mixing, phrases, quality, scoring, sharding, substring, suffix

QUERIES = {
    "op10_line_dedup": lines.query,
    "op11_centroid_clustering": centroids.query,
    "op12_lm_scoring": scoring.query,
    "op13_phrase_collocations": phrases.query,
    "op1_decontamination": decontam.query,
    "op2_source_mixing": mixing.query,
    "op3_sharding": sharding.query,
    "op4_ngram_jaccard_join": jaccard.query,
    "op5_chat_formatting": chat.query,
    "op6_substring_dedup": substring.query,
    "op7_license_scan": licenses.query,
    "op8_suffix_array_dedup": suffix.query,
    "op9_quality_rules": quality.query,
}

ORACLE_SQL = {
    "op11_centroid_clustering": centroids.ORACLE_SQL,
    "op13_phrase_collocations": phrases.ORACLE_SQL,
    "op1_decontamination": decontam.ORACLE_SQL,
    "op4_ngram_jaccard_join": jaccard.ORACLE_SQL,
    "op5_chat_formatting": chat.ORACLE_SQL,
    "op6_substring_dedup": substring.ORACLE_SQL,
    "op7_license_scan": licenses.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
}
