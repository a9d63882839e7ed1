"""The registered queries of the ten operators and their SQL."""

from latticelake.llm import bpe, decontam, idstore, langid, licences, neardup, quality, secrets, simdigest, tokencount

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_id_store": idstore.op3_id_store,
    "op4_fingerprints": simdigest.op4_fingerprints,
    "op5_language_id": langid.op5_language_id,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_quality": quality.op7_quality,
    "op8_edit_counts": tokencount.op8_edit_counts,
    "op9_decontaminate": decontam.op9_decontaminate,
    "op10_licence_scan": licences.op10_licence_scan,
}

#: Only where SQL can express the operator.
ORACLES: dict[str, str] = {"op9_decontaminate": decontam.ORACLE, "op10_licence_scan": licences.ORACLE}
