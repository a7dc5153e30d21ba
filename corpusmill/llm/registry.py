"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .decontaminate import op3_decontaminate
from .fill_in_middle import op11_fill_in_middle
from .line_dedup import OP9_SQL, op9_line_dedup
from .ngram_join import op5_ngram_join
from .packing import op7_packing
from .periodic_runs import op12_periodic_runs
from .pii import op1_pii
from .quality_rules import op8_quality_rules
from .repeated_windows import op13_substring_dedup
from .resample import op10_quality_classifier
from .secret_scan import OP2_SQL, op2_secret_scan
from .substring_dedup import op6_substring_dedup
from .token_files import op4_token_files

QUERIES = {
    "op1_pii": op1_pii,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_files": op4_token_files,
    "op5_ngram_join": op5_ngram_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE_SQL = {"op2_secret_scan": OP2_SQL, "op9_line_dedup": OP9_SQL}
