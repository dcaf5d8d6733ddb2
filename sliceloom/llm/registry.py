"""The opN_ queries and their SQL."""

from .decontaminate import op7_benchmark_leaks
from .exact import OP2_SQL, op2_exact_dedup
from .extract import op8_main_text
from .lm import op10_pseudo_likelihood
from .mixing import OP1_SQL, op1_weighted_mix
from .neardup import op6_near_duplicates
from .quality import op4_quality
from .substrings import op3_repeated_substrings
from .tokens import op5_token_files
from .warc import op9_warc

QUERIES = {
    "op1_weighted_mix": op1_weighted_mix,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_repeated_substrings": op3_repeated_substrings,
    "op4_quality": op4_quality,
    "op5_token_files": op5_token_files,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_main_text": op8_main_text,
    "op9_warc": op9_warc,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
}
ORACLE_SQL = {"op1_weighted_mix": OP1_SQL, "op2_exact_dedup": OP2_SQL}
