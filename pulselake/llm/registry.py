"""The subpackage's queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP2_SQL, op2_chat_format
from .decontaminate import op10_decontamination
from .embedding_dedup import OP5_SQL, op5_embedding_dedup
from .html_extract import op8_html_extract
from .license_scan import op4_license_scan
from .merkle_manifest import OP12_SQL, op12_merkle_manifest
from .minhash_dedup import OP9_SQL, op9_minhash_dedup
from .mixing import OP3_SQL, op3_source_mixing
from .periodic_runs import OP11_SQL, op11_periodic_runs
from .quality import op1_quality_classifier
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .url_filter import OP7_SQL, op7_url_filter
from .warc_convert import OP13_SQL, op13_warc_convert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_chat_format, op3_source_mixing, op4_license_scan, op5_embedding_dedup,
        op6_substring_dedup, op7_url_filter, op8_html_extract, op9_minhash_dedup, op10_decontamination, op11_periodic_runs, op12_merkle_manifest,
        op13_warc_convert,
    )
}
ORACLES: dict[str, str] = {"op2_chat_format": OP2_SQL, "op3_source_mixing": OP3_SQL, "op5_embedding_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_url_filter": OP7_SQL, "op9_minhash_dedup": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op12_merkle_manifest": OP12_SQL,
    "op13_warc_convert": OP13_SQL}
