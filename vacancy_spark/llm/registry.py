"""The registered queries of this subpackage and their DuckDB SQL (where SQL expresses them)."""

from vacancy_spark.llm import mixing, topk
from vacancy_spark.llm.fertility import op7_fertility_rules
from vacancy_spark.llm.near_duplicates import op4_ngram_jaccard_join
from vacancy_spark.llm.packing import op3_best_fit_packing
from vacancy_spark.llm.periodic_runs import op12_periodic_runs
from vacancy_spark.llm.personal_data import op13_personal_data
from vacancy_spark.llm.pitman_yor import op6_pitman_yor
from vacancy_spark.llm.suffix_dedup import op8_suffix_dedup
from vacancy_spark.llm.token_counts import op10_token_counts
from vacancy_spark.llm.token_files import op9_token_files
from vacancy_spark.llm.toxicity import op2_toxicity
from vacancy_spark.llm.whitening import op11_spectrum_whitening

QUERIES = {
    "op1_pareto_mixing": mixing.op1_pareto_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_threshold_top_k": topk.op5_threshold_top_k,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_fertility_rules": op7_fertility_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_files": op9_token_files,
    "op10_token_counts": op10_token_counts,
    "op11_spectrum_whitening": op11_spectrum_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_personal_data": op13_personal_data,
}
ORACLE = {
    "op1_pareto_mixing": mixing.ORACLE,
    "op5_threshold_top_k": topk.ORACLE,
}
