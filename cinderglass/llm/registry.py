"""Queries of this subpackage and the SQL that some are held against."""

from cinderglass.llm import chat_format, decontaminate, embedding_dedup, license_scan, minhash_dedup, substring_dedup
from cinderglass.llm.bpe import op5_bpe_round_trip
from cinderglass.llm.html_extract import op7_extract_pages
from cinderglass.llm.token_store import op9_token_store
from cinderglass.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_minhash_near_dedup": minhash_dedup.op2_minhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_embedding_near_dedup": embedding_dedup.op6_embedding_near_dedup,
    "op7_extract_pages": op7_extract_pages,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_token_store": op9_token_store,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE,
    "op2_minhash_near_dedup": minhash_dedup.ORACLE,
    "op4_license_scan": license_scan.ORACLE,
    "op6_embedding_near_dedup": embedding_dedup.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
}
