"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from quire.llm.decontamination import op7_benchmark_decontamination
from quire.llm.html_extraction import op5_html_extraction
from quire.llm.language_id import op6_language_id
from quire.llm.media import op3_media_columns
from quire.llm.packing import op4_best_fit_packing
from quire.llm.quality_classifier import op1_quality_classifier
from quire.llm.simhash import op8_simhash_near_dedup
from quire.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from quire.llm.url_filters import OP9_SQL, op9_url_filters
from quire.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_substring_dedup,
        op3_media_columns,
        op4_best_fit_packing,
        op5_html_extraction,
        op6_language_id,
        op7_benchmark_decontamination,
        op8_simhash_near_dedup,
        op9_url_filters,
        op10_warc,
    )
}

ORACLE_SQL = {"op2_substring_dedup": OP2_SQL, "op9_url_filters": OP9_SQL, "op10_warc": OP10_SQL}
