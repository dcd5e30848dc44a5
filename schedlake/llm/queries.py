"""The registered queries of this subpackage and, where SQL can express one, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from schedlake.llm.chat_format import CHECK as CHAT
from schedlake.llm.chat_format import op3_chat
from schedlake.llm.decontamination import op6_decontamination
from schedlake.llm.exact_dedup import op9_exact_dedup
from schedlake.llm.improbable_digest import op13_fingerprints
from schedlake.llm.quality import op4_quality
from schedlake.llm.ranked_search import CHECK as SEARCH
from schedlake.llm.ranked_search import op12_search
from schedlake.llm.secret_scan import CHECK as SECRETS
from schedlake.llm.secret_scan import op1_secrets
from schedlake.llm.sentencepiece_chunks import op7_sentencepiece
from schedlake.llm.simhash import op2_simhash
from schedlake.llm.suffix_dedup import op10_suffix_dedup
from schedlake.llm.token_alignment import op11_alignment
from schedlake.llm.token_counts import op5_token_counts
from schedlake.llm.warc import CHECK as WARC
from schedlake.llm.warc import op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_simhash": op2_simhash,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_warc": op8_warc,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_alignment": op11_alignment,
    "op12_search": op12_search,
    "op13_fingerprints": op13_fingerprints,
}

CHECKS: dict[str, str] = {
    "op1_secrets": SECRETS,
    "op3_chat": CHAT,
    "op8_warc": WARC,
    "op12_search": SEARCH,
    "op9_exact_dedup": """
        with d as (
            select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
                as text_sha256 from documents
        ), g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
        select distinct doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
    """,
}
