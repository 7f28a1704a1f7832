"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from seriesgrove.llm.bpe import op2_bpe_encode
from seriesgrove.llm.dedup import OP9_SQL, op9_near_dedup
from seriesgrove.llm.media import op3_media_columns
from seriesgrove.llm.mixing import OP6_SQL, op6_mix_sources
from seriesgrove.llm.packing import op7_pack_tokens
from seriesgrove.llm.passages import op5_shared_passages
from seriesgrove.llm.quality import op4_quality_classifier
from seriesgrove.llm.repetition import OP10_SQL, op10_repetition_rules
from seriesgrove.llm.secrets import op1_secret_scan
from seriesgrove.llm.textops import small_batches
from seriesgrove.llm.warc import op8_warc_derivatives



def _query(f):
    def run(spark, sf_dir):
        small_batches(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _query(f) for f in (op1_secret_scan, op2_bpe_encode, op3_media_columns, op4_quality_classifier, op5_shared_passages, op6_mix_sources, op7_pack_tokens, op8_warc_derivatives, op9_near_dedup, op10_repetition_rules)}
SQL: dict[str, str] = {"op6_mix_sources": OP6_SQL, "op9_near_dedup": OP9_SQL, "op10_repetition_rules": OP10_SQL}
