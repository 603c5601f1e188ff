"""The queries of this folder, and SQL for those that SQL can express."""

from fernglass.llm import audio, chat, decontaminate, importance, jaccard, langid, negatives, packing, patterns, resample, secrets, toxicity, urls

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_urls": urls.op4_urls,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_chat": chat.op7_chat,
    "op8_resampling": resample.op8_resampling,
    "op9_secrets": secrets.op9_secrets,
    "op10_audio": audio.op10_audio,
    "op11_negatives": negatives.op11_negatives,
    "op12_patterns": patterns.op12_patterns,
    "op13_importance": importance.op13_importance,
}
ORACLES: dict[str, str] = {"op6_jaccard": jaccard.OP6_SQL, "op7_chat": chat.OP7_SQL, "op11_negatives": negatives.OP11_SQL, "op13_importance": importance.OP13_SQL}
