"""User-supplied extractors and checks of their JSON answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_extractor(df: DataFrame, extractor: Callable[[str], dict | str], key: str, text: str, retries: int = 0) -> DataFrame:
    """(key, record, error): the extractor's JSON answer per document.

    The function belongs to the user and runs inside the tasks. A document that
    fails becomes an error row; the batch goes on.
    """
    kind = dict(df.dtypes)[key]

    def answer(value: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(retries + 1):
            try:
                out = extractor(value)
                return (out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, sort_keys=True)), None
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        return None, error

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = [answer(v) for v in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "record": [a[0] for a in answers], "error": [a[1] for a in answers]})

    return df.select(key, text).mapInPandas(apply, f"{key} {kind}, record string, error string")


def check_json(df: DataFrame, record: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with the parsed record, and rejected rows with the reason.

    A record is accepted when it parses under the schema and every required
    field has a value.
    """
    parsed = df.withColumn("parsed", F.from_json(
        record, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"parsed.{c}").isNull(), F.lit(c)) for c in required])), ", ")
    reason = (F.when(F.col(record).isNull(), "no record").when(F.col("parsed").isNull() | F.col("parsed._bad").isNotNull(), "not valid JSON")
              .when(missing != "", F.concat(F.lit("missing: "), missing)))
    flagged = parsed.withColumn("reason", reason)
    return flagged.where("reason IS NULL").drop("reason"), flagged.where("reason IS NOT NULL").drop("parsed")


def extract_checked(df: DataFrame, extractor: Callable[[str, str | None], dict | str], key: str, text: str, schema: str, required: list[str],
                    folder: str, attempts: int = 3) -> DataFrame:
    """(key, record, reason, attempts): answers that pass ``check_json``; what is rejected is asked again, with the reason.

    The extractor gets a text and the reason why its last answer was refused,
    null at first. Every round asks for the rejected documents alone and is
    written below ``folder``, so that no answer is asked for twice; a document
    that is still refused after ``attempts`` rounds keeps its last reason.
    Keys are distinct.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    rounds = []
    pending = df.select(key, F.col(text).alias("_text"), F.lit(None).cast("string").alias("_reason"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            records, errors = [], []
            for value, reason in zip(pdf["_text"], pdf["_reason"], strict=True):
                try:
                    out = extractor(value, None if pd.isna(reason) else reason)
                    records.append(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, sort_keys=True))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a failure is the reason of the next round
                    records.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: pdf[key], "_text": pdf["_text"], "record": records, "_error": errors})

    for number in range(1, attempts + 1):
        answers = pending.mapInPandas(ask, f"{key} {kind}, _text string, record string, _error string")
        # Answers are written before they are judged twice: an extractor may be slow, or say something else the next time.
        answers.write.parquet(f"{folder}/answers-{number}")
        stored = spark.read.schema(answers.schema).parquet(f"{folder}/answers-{number}")
        good, bad = check_json(stored, "record", schema, required)
        both = good.select(key, "_text", "record", F.lit(None).cast("string").alias("_reason")) \
            .unionByName(bad.select(key, "_text", "record", F.coalesce("_error", "reason").alias("_reason")))
        pending = both.where("_reason IS NOT NULL").select(key, "_text", "_reason")
        done = both if number == attempts else both.where("_reason IS NULL")
        rounds.append(done.select(key, "record", F.col("_reason").alias("reason"), F.lit(number).alias("attempts")))
        if number < attempts and pending.isEmpty():
            break
    out = rounds[0]
    for part in rounds[1:]:
        out = out.unionByName(part)
    return out
