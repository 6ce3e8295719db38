"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessera.llm import audio, chat, decontaminate, langid, licences, lm, neardup, oracles, pieces, quality, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_language": langid.op1_language,
    "op9_quality": quality.op9_quality,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op10_licences": licences.op10_licences,
    "op4_sharding": sharding.op4_sharding,
    "op2_chat": chat.op2_chat,
    "op8_audio": audio.op8_audio,
    "op7_lm": lm.op7_lm,
    "op5_minhash": neardup.op5_minhash,
    "op3_sentencepiece": pieces.op3_sentencepiece,
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
