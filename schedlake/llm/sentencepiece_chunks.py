"""SentencePiece encoding and decoding by a table of distinct marked words.

The normaliser turns spaces into the marker U+2581 and puts one in front.  No piece of the vocabulary
holds a marker behind another character (checked when the model is loaded), so no merge crosses the
place where a run of markers begins.  A text is therefore its chunks, each a run of markers and what
follows up to the next run; every distinct chunk is segmented once per task, and ids and decoded text
are joined back by position.

The table is kept per task, bounded by ``table_size`` entries and emptied when full: a table for the
whole corpus would shuffle every word occurrence (README has the figures).  Results do not depend on it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import per_text, table

MARKER = "▁"
CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")
LONG_CHUNK = 256  # longer ones are segmented each time: they hardly repeat


def chunk_codec(model_file: str, table_size: int) -> Callable[[str], tuple[bytes, str]]:
    """A function of a text: ids between begin and end id, packed as little-endian uint32, and the text they decode to."""
    import sentencepiece
    import struct

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    if any(re.search(f"[^{MARKER}]{MARKER}", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("pieces of this model cross white space: chunks can't be segmented alone")
    marker_id = sp.piece_to_id(MARKER)
    known: dict[str, tuple[bytes, str]] = {}
    begin, end = (struct.pack("<I", i) for i in (sp.bos_id(), sp.eos_id()))

    def segment(chunk: str) -> tuple[bytes, str]:
        # the library puts the first marker in front itself, but not before an empty text
        ids = sp.encode(chunk[1:]) if len(chunk) > 1 else [marker_id]
        return struct.pack(f"<{len(ids)}I", *ids), " " + sp.decode(ids)

    def code(text: str) -> tuple[bytes, str]:
        if not text:
            return begin + end, ""
        chunks = CHUNK.findall(MARKER + text.replace(" ", MARKER))
        if len(known) > table_size:
            known.clear()
        for chunk in set(chunks).difference(known):
            if len(chunk) <= LONG_CHUNK:
                known[chunk] = segment(chunk)
        found = [known.get(c) or segment(c) for c in chunks]
        return b"".join([begin, *[x[0] for x in found], end]), "".join([x[1] for x in found])[1:]

    return code


def encode_decode(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = 200_000
) -> DataFrame:
    """Per row: the id, ``ids`` (binary, little-endian uint32, with begin and end ids) and ``decoded``.

    Null texts are empty: two ids, empty decoded text.  Repeated rows and rows without an id each give a row.
    Other columns are not read.  An empty table gives an empty result.
    """

    def work():
        return chunk_codec(model_file, table_size)

    return per_text(docs, id_col, text_col, "ids binary, decoded string", work)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
