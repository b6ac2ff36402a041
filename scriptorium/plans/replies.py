"""Replies of a model, kept: a prompt is paid for once.

A reply store is a collection keyed by the prompt's hash. Prompts are asked
once however many rows have them, and only those without a stored answer;
replies are written before anything that is made from them, ``WAVE`` prompts a
version, so what comes after may fail and run again without another call.
Failures are stored, too, for the record, and asked again in the next run. A
task that Spark repeats, as its executor was lost, asks its own prompts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.plans import providers
from scriptorium.schemas import REPLY
from scriptorium.sources.store import Collection

#: Prompts that are asked before their replies are written, about.
WAVE = 10_000


class Replies:
    def __init__(self, spark: SparkSession, path: str):
        self.store = Collection(spark, path, REPLY, keys=("prompt_hash",))

    def stored(self) -> DataFrame:
        """(prompt_hash, answer) of all prompts with an answer."""
        return self.store.read("prompt_hash", "answer").where("answer is not null")

    def answered(self, rows: DataFrame, prompt: Column, model: providers.Model, into: str = "reply", wave: int = WAVE) -> DataFrame:
        """``rows`` with (answer, error) in ``into``; the calls are made here, not when the result is read."""
        spark = rows.sparkSession
        marked = rows.withColumn("prompt_hash", F.sha2(prompt.cast("binary"), 256))
        asked = marked.select("prompt_hash", prompt.alias("prompt")).where("prompt is not null").dropDuplicates(["prompt_hash"])
        left = asked.join(self.stored(), "prompt_hash", "left_anti")
        waves = -(-left.count() // wave)
        failed = []
        for w in range(waves):
            some = asked.where(F.pmod(F.xxhash64("prompt_hash"), F.lit(waves)) == w).join(self.stored(), "prompt_hash", "left_anti")
            # calls are slow and their rows few: one task would make them one after another
            some = some.repartition(max(1, min(wave, spark.sparkContext.defaultParallelism)), "prompt_hash")
            new = some.withColumn("r", providers.answered(F.col("prompt"), model)).select("prompt_hash", "r.answer", "r.error", F.current_timestamp().alias("asked_at"))
            failed.append(self.store.replace_groups(new, "prompt_hash").where("answer is null").select("prompt_hash", "answer", "error"))
        replies = self.stored().withColumn("error", F.lit(None).cast("string"))
        for f in failed:
            replies = replies.unionByName(f)
        none = F.struct(F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"))
        out = marked.join(replies.select("prompt_hash", F.struct("answer", "error").alias(into)), "prompt_hash", "left")
        return out.withColumn(into, F.coalesce(into, none)).select(*rows.columns, into)
