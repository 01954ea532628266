"""Streaming forms of the submission and log operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder; the checkpoint remembers those already read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def received(stream: DataFrame, body: str = "body", most: int = 10_000_000, late: str | None = None) -> DataFrame:
    """JSON bodies up to ``most`` bytes, each content once: at-most-once by SHA-256.

    With ``late`` (and a ts column) hashes older than that are forgotten, which bounds the state.
    """
    good = stream.where((F.octet_length(body) <= most) & F.ltrim(body).startswith("{")).withColumn("sha", F.sha2(body, 256))
    if late:
        return good.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sha"])
    return good.dropDuplicates(["sha"])


def best_so_far(stream: DataFrame) -> DataFrame:
    """The least kmpp of each config and the first id that had it, in update mode."""
    kept = stream.where("kmpp >= 1e-6")
    return kept.groupBy("config").agg(F.min("kmpp").alias("kmpp"), F.min_by("id", F.struct("kmpp", "id")).alias("id"), F.count(F.lit(1)).alias("n"))


def last_n_stream(stream: DataFrame, n: int) -> DataFrame:
    """Per run the range of the last n values, kept as a ring in state.  stream: run, generation, kmpp.
    A batch is put in order of generation; what comes in a later batch counts as later."""

    def ring(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gens, vals = state.get if state.exists else ([], [])
        new = pd.concat(list(frames)).sort_values("generation")
        held = pd.Series([*vals, *new["kmpp"]], dtype=float).rolling(n, min_periods=1)
        out = pd.DataFrame({"low": held.min(), "high": held.max(), "n": held.count()}).iloc[len(vals) :]
        state.update(([*gens, *new["generation"].tolist()][-n:], [*vals, *new["kmpp"].tolist()][-n:]))
        yield pd.DataFrame({"run": key[0], "generation": new["generation"].to_numpy(), "low": out["low"].to_numpy(), "high": out["high"].to_numpy(), "n": out["n"].to_numpy(int)})

    return stream.groupBy("run").applyInPandasWithState(ring, "run long, generation int, low double, high double, n int", "generations array<int>, vals array<double>", "append", GroupStateTimeout.NoTimeout)


def failure_monitor(stream: DataFrame, n: int, most: int) -> DataFrame:
    """Per config whether at least ``most`` of the last n finishes failed.  stream: config, seq, ok."""

    def watch(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for seq, ok in pd.concat(list(frames)).sort_values("seq")[["seq", "ok"]].itertuples(index=False):
            held = [*held, not ok][-n:]
            out.append((key[0], int(seq), sum(held), sum(held) >= most))
        state.update((held,))
        yield pd.DataFrame(out, columns=["config", "seq", "failed", "stop"])

    return stream.groupBy("config").applyInPandasWithState(watch, "config string, seq long, failed long, stop boolean", "held array<boolean>", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Drive a stream over all input that is there and return its result table.

    Append results are written as Parquet; complete and update results keep the last value a batch gives.
    """
    spark = stream.sparkSession
    out, marks = f"{folder}/out", f"{folder}/marks"
    if mode == "append":
        query = stream.writeStream.outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).format("parquet").start(out)
    else:
        query = stream.writeStream.outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
