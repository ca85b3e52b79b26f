"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gazelark.llm import alignment, chat, flac, language, licences, near_duplicates, neighbours, packing, pair_index, personal, segmentation, sharding, vector_codes
from gazelark.llm.tables import own_session


def _apart(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(own_session(spark), sf_dir)


_QUERIES = {
    "op1_minhash_dedup": near_duplicates.query,
    "op2_license_scan": licences.query,
    "op3_chat_format": chat.query,
    "op4_nearest_neighbours": neighbours.query,
    "op5_sentencepiece": segmentation.query,
    "op6_packing": packing.query,
    "op7_pii": personal.query,
    "op8_language_id": language.query,
    "op9_sharding": sharding.query,
    "op10_media_columns": flac.query,
    "op11_bpe": pair_index.query,
    "op12_vector_codes": vector_codes.query,
    "op13_token_alignment": alignment.query,
}
QUERIES = {name: _apart(query) for name, query in _QUERIES.items()}
ORACLE_SQL = {
    "op2_license_scan": licences.ORACLE_SQL,
    "op9_sharding": sharding.ORACLE_SQL,
}
