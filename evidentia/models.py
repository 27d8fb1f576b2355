"""The boundary to models: encoders and text providers behind small interfaces.

The defaults are no real models: a deterministic hashing encoder, and a provider that
replays recorded texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import conclusions
from .functions.vectors import yes_probability


class Encoder(Protocol):
    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Unit vectors of hashed lower-case character trigrams."""

    def __init__(self, dim: int = 64):
        self.dim, self.name = dim, f"hashing-{dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, t in enumerate(texts):
            t = f"  {t.lower()}  "
            for i in range(len(t) - 2):
                h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest(), "little")
                out[k, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def pool(states: np.ndarray, how: str) -> np.ndarray:
    """Text vectors of token states (texts, tokens, dim): the first token's, or the mean over all positions, padding too."""
    if how == "first":
        return states[:, 0]
    if how == "mean":
        return states.mean(1)
    raise ValueError(f"unknown pooling: {how}")


def embed(texts: DataFrame, encoder: Encoder, batch: int = 64) -> DataFrame:
    """(text, embedding) of the distinct texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f["text"].iloc[lo : lo + batch].tolist()
                yield pd.DataFrame({"text": part, "embedding": list(encoder.encode(part))})

    return texts.select("text").where("text IS NOT NULL").distinct().mapInPandas(run, "text string, embedding array<double>")


def embed_cached(texts: DataFrame, encoder: Encoder, path: str) -> DataFrame:
    """As :func:`embed`, with a Parquet cache keyed by model name and text hash: only new texts are encoded."""
    spark = texts.sparkSession
    schema = "model string, text_hash string, text string, embedding array<double>"
    wanted = texts.select("text").where("text IS NOT NULL").distinct().withColumn("text_hash", F.sha2("text", 256))
    try:
        have = spark.read.schema(schema).parquet(path).where(F.col("model") == encoder.name)
        new = wanted.join(have.select("text_hash"), "text_hash", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = wanted
    embed(new, encoder).select(F.lit(encoder.name).alias("model"), F.sha2("text", 256).alias("text_hash"), "text", "embedding").write.mode("append").parquet(path)
    have = spark.read.schema(schema).parquet(path).where(F.col("model") == encoder.name)
    return wanted.join(have.drop("text", "model"), "text_hash").select("text", "embedding")


class Provider(Protocol):
    """Answers prompts: (text, p_yes, p_no) each; probabilities may be None."""

    def answer(self, prompts: list[str]) -> list[tuple[str, float | None, float | None]]: ...


def generate(prompts: DataFrame, provider: Provider, on_error: str = "empty", batch: int = 64) -> DataFrame:
    """All columns of ``prompts`` (with ``prompt``) and generated_text, p_yes, p_no.

    The provider gets ``batch`` prompts a call; if that fails, each by itself, and a
    failing one gives an empty text, or with ``on_error`` "note" the text ``NONE  # error: ...``.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("generated_text", T.StringType()), T.StructField("p_yes", T.DoubleType()), T.StructField("p_no", T.DoubleType())])

    def one(prompt):
        try:
            return provider.answer([prompt])[0]
        except Exception as e:  # noqa: BLE001
            return ("" if on_error == "empty" else f"NONE  # error: {e}", None, None)

    def many(part):
        try:
            got = provider.answer(part)
            if len(got) == len(part):
                return got
        except Exception:  # noqa: BLE001, S110 - asked again one by one, which notes the error
            pass
        return [one(p) for p in part]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            asked = f["prompt"].tolist()
            got = [g for lo in range(0, len(asked), batch) for g in many(asked[lo : lo + batch])]
            number = lambda k: pd.array([g[k] for g in got], "Float64").to_numpy(float, na_value=np.nan)
            yield f.assign(generated_text=[g[0] for g in got], p_yes=number(1), p_no=number(2))

    return prompts.mapInPandas(run, schema).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("p_yes", "p_no")})


def replay(prompts: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded generations (keys, generated_text) joined to the prompts; without one the text is empty."""
    return prompts.join(recorded, keys, "left").withColumn("generated_text", F.coalesce("generated_text", F.lit("")))


def predictions(generated: DataFrame) -> DataFrame:
    """Adds parsed, pred_label (null if unparsed) and score_p_yes (0.5 if unparsed or without probabilities)."""
    said = conclusions.anywhere(F.col("generated_text"))
    truth = F.coalesce((said == "Yes").cast("int"), conclusions.anywhere_truth(F.col("generated_text")))
    p = lambda c: F.col(c) if c in generated.columns else F.lit(None).cast("double")
    return generated.withColumns({"pred_label": truth, "parsed": truth.isNotNull(), "score_p_yes": F.when(truth.isNotNull(), yes_probability(p("p_yes"), p("p_no"))).otherwise(0.5)})
