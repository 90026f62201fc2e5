"""Comment streams.

The store is an append-only log with one folder per run and micro-batch (``run_id=Q/batch_id=N``). A run belongs to a
checkpoint, so a batch that is retried after a failure overwrites its own folder and delivery is exactly-once without
rewriting the table, while a new checkpoint over an old log starts a run of its own and erases nothing. Runs are
numbered in the order in which they start.

Copies of a comment stay in the log: readers reduce it to the newest present value of each field. What must happen once
per comment, scoring and counting, reads the stream through ``first_arrivals``, which keeps the keys it has met in the
state store, however late a copy comes.

A log that has many batches is compacted: their state, with the time of each field, is written as a snapshot, and a
generation names the snapshot and the last batch of each run in it. Readers merge the newest snapshot and the batches
after it. A batch counts once its folder is complete.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import metrics as mx
from ..functions import sentiment as sx
from ..functions import text as tx
from ..operators import scoring, upsert
from ..session import Workspace, remove
from ..sources import generations

KEY = ["platform", "platform_id"]
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def on_disk_state(spark: SparkSession) -> None:
    """Keys of a long stream outgrow memory: keep state in RocksDB unless the session names another store."""
    if spark.conf.get(STATE_STORE).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Rows of the files in a folder, as they come. The log of another query is such a folder."""
    on_disk_state(spark)
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def first_arrivals(comments: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row per comment key, the first to arrive; works on batch and streaming input.

    There is no watermark, so nothing late is lost. The state grows by one key per comment and lives in the state store.
    """
    return comments.dropDuplicates(key)


def run_name(spark: SparkSession, log: str, checkpoint: str) -> str:
    """Folder of the run that a checkpoint stands for: the one it has, or the next number."""
    mark = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    runs = [n for n in generations.children(spark, log) if n.startswith("run_id=")]
    own = [n for n in runs if n.endswith(mark)]
    number = 1 + max((int(n.split("=r")[1].split("-")[0]) for n in runs), default=0)
    return own[0] if own else f"run_id=r{number:06d}-{mark}"


def _append(batch: DataFrame, folder: str) -> None:
    batch.write.mode("overwrite").parquet(folder)


def ingest(stream: DataFrame, log: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None,
           name: str | None = None, compact_every: int = 0) -> StreamingQuery:
    """Land a stream in the log and run the follow-on step for each landed batch. Runs until caught up.

    With ``compact_every``, the log is compacted whenever so many batches have landed."""
    run = f"{log}/{run_name(stream.sparkSession, log, checkpoint)}"

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{run}/batch_id={batch_id}"
        _append(batch, folder)
        if after is not None:
            # Re-read what was landed: the follow-on step never recomputes the source.
            after(batch.sparkSession.read.parquet(folder), batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, log)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(availableNow=True).start()


def score_once(stream: DataFrame, scores: str, scorer: scoring.Scorer, checkpoint: str) -> StreamingQuery:
    """Score every comment of a stream once and log (key, label, score). Runs until caught up.

    Copies within the run are known from the state store; what an earlier run scored is taken out by a join with its
    part of the log, which is there to read only after a change of checkpoint.
    """
    spark = stream.sparkSession
    run = run_name(spark, scores, checkpoint)
    folders = {n: f"{scores}/{n}" for n in generations.children(spark, scores) if n.startswith("run_id=")}
    earlier = [path for n, path in folders.items() if n != run]

    def step(batch: DataFrame, batch_id: int) -> None:
        todo = batch
        if earlier:
            known = batch.sparkSession.read.parquet(*earlier).select(*KEY)
            todo = todo.join(known, KEY, "left_anti")
        for c, t in (("sentiment_processed", "boolean"), ("sentiment_label", "string"), ("sentiment_score", "double")):
            if c not in todo.columns:
                todo = todo.withColumn(c, F.lit(None).cast(t))
        # Scoring reads the batch three times; each time would look all its keys up in the state store again.
        with Workspace(batch.sparkSession, "arrived") as work:
            todo = work.save(todo, "batch")
            _append(scoring.score_unprocessed(todo, scorer, F.current_timestamp()), f"{scores}/{run}/batch_id={batch_id}")

    writer = first_arrivals(stream).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


# --- reading a log -------------------------------------------------------------------------------------

def batches(spark: SparkSession, log: str, covered: dict[str, int] | None = None) -> list[str]:
    """Folders of the complete batches of a log, without those up to the ``covered`` one of each run."""
    found = []
    for run in (n for n in generations.children(spark, log) if n.startswith("run_id=")):
        for name in generations.children(spark, f"{log}/{run}"):
            number = int(name.split("=")[1])
            if number > (covered or {}).get(run, -1) and generations.is_complete(spark, f"{log}/{run}/{name}"):
                found.append(f"{log}/{run}/{name}")
    return found


def _states(spark: SparkSession, log: str) -> tuple[DataFrame | None, int, dict, list[str]]:
    """State of the log as field states, and the generation, its content and the batches after it."""
    number, content = generations.newest(spark, log)
    later = batches(spark, log, content.get("covered"))
    parts = []
    if content:
        parts.append(spark.read.parquet(f"{log}/{content['snapshot']}"))
    if later:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
            spark.read.parquet(*group) for group in _by_run(later)])
        parts.append(upsert.field_states(rows))
    if len(parts) == 2:
        parts = [upsert.merged_states(parts[0].unionByName(parts[1], allowMissingColumns=True))]
    return (parts[0] if parts else None), number, content, later


def _by_run(folders: list[str]) -> list[list[str]]:
    """Folders of one run share a schema."""
    runs: dict[str, list[str]] = {}
    for f in folders:
        runs.setdefault(os.path.dirname(f), []).append(f)
    return list(runs.values())


def compact(spark: SparkSession, log: str, clean: bool = True) -> None:
    """Write the state of a comment log as its next snapshot. Batches it covers, and the snapshot before the last one,
    are removed afterwards, if ``clean``. A job that dies before the generation is published leaves the log as it was."""
    states, number, content, later = _states(spark, log)
    if not later:
        return
    snapshot = f"_snapshot-{number + 1:012d}"
    states.write.mode("overwrite").parquet(f"{log}/{snapshot}")
    covered = dict(content.get("covered", {}))
    for folder in later:
        run, batch = folder.split("/")[-2:]
        covered[run] = max(covered.get(run, -1), int(batch.split("=")[1]))
    generations.publish(spark, log, number + 1, {"snapshot": snapshot, "covered": covered, "before": content.get("snapshot")})
    if clean:
        # A reader of the generation before may still be at work on its snapshot, so that one stays for a while.
        for folder in [*later, *([f"{log}/{content['before']}"] if content.get("before") else [])]:
            remove(spark, folder)


def comment_state(spark: SparkSession, log: str, scores: str | None = None) -> DataFrame:
    """Current state of a log: newest present value per field and key, scores merged on top."""
    states = _states(spark, log)[0]
    if states is None:
        raise FileNotFoundError(f"no complete batch in {log}")
    state = upsert.of_states(states)
    scored = [] if scores is None else batches(spark, scores)
    if not scored:
        return state
    rows = spark.read.parquet(*scored).drop("ingested_at")  # the time of the copy that was scored
    return upsert.set_fields(state, rows, order=("sentiment_processed_at",))


# --- running aggregates ----------------------------------------------------------------------------------

def running_distribution(scored: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Cumulative label counts per account over distinct comments; works on batch and streaming input."""
    return first_arrivals(scored).groupBy("platform", "parent_id").agg(*sx.label_counts(F.col(label)))


def running_shares(stream: DataFrame) -> DataFrame:
    """First and last share and share count per linked video over distinct comments; works on batch and streaming input."""
    reddit = first_arrivals(stream.where(F.col("platform") == "reddit"))
    linked = reddit.select(
        F.explode_outer(tx.video_ids(F.col("body"))).alias("video_id"), "published_at"
    ).where(F.col("video_id").isNotNull())
    return linked.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("shares"),
        F.min("published_at").alias("first_shared_at"),
        F.max("published_at").alias("last_shared_at"),
    )


def share_delays(shares: DataFrame, videos: DataFrame) -> DataFrame:
    """Delay and speed class of running shares, in the stream, against the static video table."""
    j = shares.join(videos.select("video_id", "published_at"), "video_id", "left")
    delay = mx.delay_hours(F.col("published_at"), F.col("first_shared_at"))
    return j.select(
        "video_id", "shares", "first_shared_at", "last_shared_at", delay.alias("propagation_delay_hours"),
        mx.delay_class(delay, F.col("first_shared_at"), "Recent Community Discovery").alias("propagation_speed"),
    )


def run_updates(aggregated: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Log the changed groups of a running aggregate (update mode), one folder per batch."""
    run = f"{log}/{run_name(aggregated.sparkSession, log, checkpoint)}"
    return (
        aggregated.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: _append(batch, f"{run}/batch_id={batch_id}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_update(log: DataFrame, key: list[str]) -> DataFrame:
    """Latest logged value of each group: the last batch of the last run that logged it."""
    values = F.struct(*[c for c in log.columns if c not in (*key, "run_id", "batch_id")])
    return log.groupBy(*key).agg(F.max_by(values, F.struct("run_id", "batch_id")).alias("_v")).select(*key, "_v.*")
