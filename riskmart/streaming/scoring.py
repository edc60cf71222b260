"""STR-1 / STR-2: applicants arriving as files, scored by the same
DataFrame code as the batch path.

The stream is stateless (each request is scored on its own), so it needs no
watermark; ``foreachBatch`` writes the decisions and the rejected requests
of each micro-batch into folders named by the batch id with overwrite, and
then one commit record, by one rename.  ``read_scored`` shows the batches that
have a record, so both outputs of a batch are seen together or not at all.  A
batch run again after a failure between the writes replaces its own folders;
one run again after its record is there changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators import decision as DC
from riskmart.operators import features as FE
from riskmart.operators import scorecard as SC
from riskmart.operators import validation as VA
from riskmart.sources.readers import parse_requests
from riskmart.sources.sinks import write_decisions


def decide_valid(valid: DataFrame, scorer: str = "logit", bundle=None) -> DataFrame:
    """The decisions of checked requests.  ``scorer``: 'logit' (closed-form
    probability), 'model' (``bundle``) or 'fallback' (no model)."""
    if scorer == "model":
        from riskmart.plans.training import score_requests
        if bundle is None:
            raise ValueError("scorer 'model' needs a bundle")
        return score_requests(valid, bundle)
    carded = SC.scorecard(FE.enrich(valid), with_details=True)
    if scorer == "fallback":
        return DC.decide(carded, has_model=False)
    return DC.decide(SC.applicant_logit(carded), has_model=True)


def decide_batch(requests: DataFrame, scorer: str = "logit", bundle=None) -> tuple[DataFrame, DataFrame]:
    """(decisions, rejected) for one batch of typed requests."""
    valid, rejected = VA.split_valid(VA.prepare_requests(requests))
    return decide_valid(valid.drop(VA.VIOLATIONS), scorer, bundle), rejected


COMMIT = "batch bigint, query string, n_decisions bigint, n_rejected bigint"


def commits_path(out_dir: str) -> str:
    """The folder of the commit records of a stream that writes to ``out_dir``."""
    return out_dir.rstrip("/") + ".commits"


def _commit(spark: SparkSession, out_dir: str, record: dict) -> None:
    """Publish a batch's record; one that is there already stays."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(commits_path(out_dir))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    draft, final = hadoop(folder, f"_{uuid.uuid4().hex}"), hadoop(folder, f"{record['batch']:012d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    if not fs.rename(draft, final):
        raise OSError(f"cannot publish {final}")


def _committed(spark: SparkSession, out_dir: str, batch_id: int, query: str) -> bool:
    """Whether the batch has a record; one of another stream is an error, as
    its batch of that number held other requests."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(commits_path(out_dir), f"{batch_id:012d}.json")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return False
    record = spark.read.schema(COMMIT).json(path.toString()).first()
    if record.query != query:
        raise ValueError(f"{out_dir} holds batch {batch_id} of another stream; its checkpoint is not the one given")
    return True


def read_commits(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per committed batch, with the rows its two outputs hold."""
    return spark.read.schema(COMMIT).json(commits_path(out_dir))


def read_scored(spark: SparkSession, out_dir: str) -> DataFrame:
    """The rows of the committed batches in ``out_dir``, with ``batch``."""
    return _of_committed(spark, out_dir, out_dir)


def read_rejected(spark: SparkSession, out_dir: str, rejected_dir: str) -> DataFrame:
    """The rejected requests of the batches committed in ``out_dir``."""
    return _of_committed(spark, rejected_dir, out_dir)


def _of_committed(spark: SparkSession, folder: str, out_dir: str) -> DataFrame:
    rows = spark.read.parquet(folder).withColumn("batch", F.col("batch").cast("bigint"))
    return rows.join(read_commits(spark, out_dir).select("batch"), "batch", "left_semi")


def score_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                 rejected_dir: str | None = None, scorer: str = "logit", bundle=None,
                 available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the scoring stream; returns the ``StreamingQuery``.  Read its
    outputs with ``read_scored`` and ``read_rejected``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # raw JSON lines: explicit nulls are told apart from absent keys
    requests = VA.coerce(parse_requests(reader.load(in_dir)))

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if _committed(spark, out_dir, batch_id, query):
            return
        checked = VA.prepare_requests(batch).persist()       # parsed and checked once for both outputs
        try:
            valid, rejected = VA.split_valid(checked)
            decisions = decide_valid(valid.drop(VA.VIOLATIONS), scorer, bundle)
            write_decisions(decisions, f"{out_dir}/batch={batch_id}", mode="overwrite")   # SNK-3
            if rejected_dir:
                rejected.write.mode("overwrite").parquet(f"{rejected_dir}/batch={batch_id}")
            bad = F.size(VA.VIOLATIONS) > 0
            n = checked.agg(F.count_if(~bad).alias("n_decisions"), F.count_if(bad).alias("n_rejected")).first()
            _commit(spark, out_dir, {"batch": batch_id, "query": query, **n.asDict()})
        finally:
            checked.unpersist()

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def score_stream_append(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                        scorer: str = "logit", bundle=None):
    """STR-1 without side output: the decision rows appended to a parquet
    sink (file sink, exactly-once through its commit log)."""
    requests = VA.coerce(parse_requests(spark.readStream.format("text").load(in_dir)))
    valid = VA.split_valid(VA.prepare_requests(requests))[0].drop(VA.VIOLATIONS)
    return (decide_valid(valid, scorer, bundle).writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def write_requests_json(requests: DataFrame, path: str, files: int | None = None) -> None:
    """Write typed requests as JSON lines with every value as text (the
    shape the service receives).  One file per partition; ``files`` spreads
    the rows over that many files (small fixtures that should arrive as
    several stream files)."""
    as_text = requests.select(*[F.col(c).cast("string").alias(c) if c != "applicant_id" else F.col(c)
                                for c in requests.columns])
    (as_text.repartition(files) if files else as_text).write.mode("overwrite").json(path)
