"""Routing tables and templates for models, as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Aliases and the assets behind them.
ASSETS = [
    ("qwen2.5:0.5b", "gguf", "Qwen/Qwen2.5-0.5B-Instruct-GGUF", "qwen2.5-0.5b-instruct-q4_k_m.gguf", "Qwen/Qwen2.5-0.5B-Instruct"),
    ("qwen2.5:0.5b-base", "gguf", "Qwen/Qwen2.5-0.5B-GGUF", "qwen2.5-0.5b-q4_k_m.gguf", "Qwen/Qwen2.5-0.5B"),
    ("llama3.2:1b", "gguf", "bartowski/Llama-3.2-1B-Instruct-GGUF", "Llama-3.2-1B-Instruct-Q4_K_M.gguf", "unsloth/Llama-3.2-1B-Instruct"),
    ("llama3.2:1b-base", "gguf", "bartowski/Llama-3.2-1B-GGUF", "Llama-3.2-1B-Q4_K_M.gguf", "unsloth/Llama-3.2-1B"),
    ("system-embedder", "safetensors", "nomic-ai/nomic-embed-text-v1.5", None, None),
    ("all-minilm", "safetensors", "sentence-transformers/all-MiniLM-L6-v2", None, None),
]
# Substrings of a lower-cased name, in the order they are tried, and the tokenizer family.
FAMILIES = [
    ("qwen2.5", ["qwen2.5"]),
    ("llama4", ["llama4", "llama-4"]),
    ("llama3.3", ["llama3.3", "llama-3.3"]),
    ("llama3.2", ["llama3.2", "llama3", "llama-3.2", "llama-3"]),
    ("llama2", ["llama2", "llama-2"]),
    ("codellama", ["codellama"]),
]
# Stop tokens by id and by name, and prompt templates.
STOP_IDS = {"llama": [128001, 128009], "qwen2": [151645, 151643]}
STOP_NAMES = {"llama": ["<|eot_id|>", "<|end_of_text|>", "</s>"], "qwen2": ["<|im_end|>", "<|endoftext|>"]}
LLAMA2 = ("<s>[INST] <<SYS>>\nYou are a helpful AI.\n<</SYS>>\n\n", " [/INST]")
LLAMA3 = ("<|start_header_id|>system<|end_header_id|>\n\nYou are a helpful AI.<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n")
QWEN = ("<|im_start|>system\nYou are a helpful AI assistant.<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n")
# How texts are split before merges.
QWEN2_SPLIT = r"(?:'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD])|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
LLAMA3_SPLIT = r"(?:'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD])|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLITS = {"qwen2": QWEN2_SPLIT, "llama3": LLAMA3_SPLIT, "smaug-bpe": LLAMA3_SPLIT, "lfm2": LLAMA3_SPLIT}


def assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASSETS, "alias string, kind string, repo string, file string, base_repo string")


def resolve(names: DataFrame, spark: SparkSession) -> DataFrame:
    """``names`` (alias) with the asset; nulls for an unknown alias. The table is fixed, so it is broadcast."""
    return names.join(F.broadcast(assets(spark)), "alias", "left")


def _any(low: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def tokenizer_family(name: Column, arch: Column) -> Column:
    out, low = None, F.lower(name)
    for family, parts in FAMILIES:
        out = F.when(_any(low, parts), family) if out is None else out.when(_any(low, parts), family)
    return out.otherwise(arch)


def generator(arch: Column) -> Column:
    """llama or qwen2; any other architecture is an error when it is evaluated."""
    return F.when(arch.isin("llama", "qwen2"), arch).otherwise(F.raise_error(F.concat(F.lit("unsupported architecture: "), F.coalesce(arch, F.lit("null")))))


def embedder(config_json: Column) -> Column:
    """The first architecture of a config, BertModel where there is none: bert or nomic, else null."""
    arch = F.coalesce(F.get_json_object(config_json, "$.architectures[0]"), F.lit("BertModel"))
    return F.when(arch == "BertModel", "bert").when(arch == "NomicBertModel", "nomic")


def chat_prompt(name: Column, arch: Column, prompt: Column) -> Column:
    low = F.lower(name)

    def put(template: tuple[str, str]) -> Column:
        return F.concat(F.lit(template[0]), prompt, F.lit(template[1]))

    return F.when(F.contains(low, F.lit("-base")), prompt).when(arch == "qwen2", put(QWEN)).when(_any(low, ["llama2", "llama-2"]), put(LLAMA2)).otherwise(put(LLAMA3))


def stop_tokens(arch: str, vocabulary: Column) -> Column:
    """The fixed ids, then those of the names in a map from token to id; duplicates stay."""
    named = F.filter(F.array(*(F.element_at(vocabulary, F.lit(n)) for n in STOP_NAMES[arch])), lambda x: x.isNotNull())
    return F.concat(F.array(*map(F.lit, STOP_IDS[arch])), named)


def until_stop(tokens: Column, stops: Column) -> Column:
    """The tokens before the first stop token."""
    hit = F.array_position(F.transform(tokens, lambda t: F.array_contains(stops, t)), True)
    return F.when(hit == 0, tokens).otherwise(F.slice(tokens, F.lit(1), (hit - 1).cast("int")))


def special_ids(types: Column) -> Column:
    """Positions whose token type is 2 to 5."""
    return F.filter(F.transform(types, lambda t, i: F.when(t.between(2, 5), i)), lambda x: x.isNotNull())


def token_text(tokens: Column, token_id: Column) -> Column:
    """The token of an id in a vocabulary's array; null beyond it."""
    return F.get(tokens, token_id)


def merge_pair(merge: Column) -> Column:
    """A merge rule "a b" as its two sides; the first space parts them."""
    parts = F.split(merge, " ", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("left"), F.get(parts, F.lit(1)).alias("right"))


def nfc(text: Column) -> Column:
    """Texts in Unicode's composed form, which no built-in function gives."""

    def composed(texts: pd.Series) -> pd.Series:
        from unicodedata import is_normalized, normalize

        return texts.map(lambda t: t if t is None or t.isascii() or is_normalized("NFC", t) else normalize("NFC", t))

    return F.pandas_udf(composed, StringType())(text)


def pre_split(text: Column, kind: str) -> Column:
    """The pieces of a text that merges stay within; a kind without rules of its own splits at the byte level, after a space in front."""
    if kind == "qwen2":
        text = nfc(text)
    elif kind not in SPLITS:
        text = F.when(F.startswith(text, F.lit(" ")) | (text == ""), text).otherwise(F.concat(F.lit(" "), text))
    return F.regexp_extract_all(text, F.lit("(?U)" + SPLITS.get(kind, BYTE_LEVEL_SPLIT)), F.lit(0))


def folder_name(name: Column) -> Column:
    return F.replace(name, F.lit(":"), F.lit("-"))


def display_name(folder: Column) -> Column:
    return F.replace(folder, F.lit("-"), F.lit(":"))


def megabytes(size: Column) -> Column:
    return F.expr("cast(0 as bigint)") + F.floor(size / (1024 * 1024))


def gigabytes(size: Column) -> Column:
    return F.round(size / (1024.0 * 1024 * 1024), 2)


def tokenizer_path(local: Column, family: Column, embedded: Column) -> Column:
    """The first that exists: beside the model, of the family, within the model file."""
    return F.coalesce(local, family, embedded)
