"""Schemas of the library's tables. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _of(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


STRINGS = ArrayType(StringType())

CHUNKS = _of(pipe=StringType(), seq=LongType(), text=StringType(), vector=ArrayType(FloatType()), source_app=StringType(), ts_s=LongType())
CACHE = _of(model=StringType(), text_key=StringType(), vector=ArrayType(FloatType()), ts_s=LongType())
MESSAGES = _of(from_app=StringType(), to_app=StringType(), payload=StringType(), timestamp=LongType(), seq=LongType())
REQUESTS = _of(app_id=StringType(), ts=TimestampType(), req_id=LongType(), cost=IntegerType())
SHARE_REQUEST = _of(request_id=LongType(), source_app=StringType(), target_pipe=StringType(), knowledge_text=StringType(), chunk_size=IntegerType(), chunk_overlap=IntegerType(), chunk_strategy=StringType())
SEARCH_REQUEST = _of(source_app=StringType(), target_pipe=StringType(), query=StringType(), filter_app=StringType(), top_k=IntegerType())
SEND_REQUEST = _of(from_app=StringType(), to_app=StringType(), payload=StringType())
RUN_REQUEST = _of(model=StringType(), prompt=StringType())
TURN = _of(role=StringType(), content=StringType())
HISTORY = _of(app_id=StringType(), history=ArrayType(TURN))
MANIFEST = _of(
    app_id=StringType(),
    description=StringType(),
    version=StringType(),
    privacy=_of(enforce_pii_redaction=BooleanType()),
    resources=_of(allowed_models=STRINGS, max_tokens_per_minute=LongType(), gpu_priority=StringType(), json_history=BooleanType(), stateful_paging=BooleanType()),
    memory_limits=_of(max_chat_history_messages=LongType(), auto_summarize_on_cap=BooleanType()),
    file_system=_of(allowed_read_paths=STRINGS, allowed_write_paths=STRINGS, max_file_size_mb=LongType()),
    network=_of(network_enabled=BooleanType(), allowed_domains=STRINGS, allow_localhost_access=BooleanType()),
    execution=_of(can_execute_shell=BooleanType(), can_execute_wasm=BooleanType(), allowed_tools=STRINGS),
    ipc=_of(allowed_agent_targets=STRINGS, allowed_semantic_pipes=STRINGS),
)
