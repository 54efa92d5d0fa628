"""The same analysis over a stream of documents: every step but the report is per document and keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pactum.operators import report, rules
from pactum.operators.segmentation import segment


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of Parquet files as they arrive in a folder."""
    return spark.readStream.schema("doc_id long, text string").parquet(folder)


def findings(stream: DataFrame) -> DataFrame:
    """Findings of a stream of documents (doc_id, text): narrow, so it runs as it does on a table."""
    return rules.run_rules(segment(stream))


def run(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes risk by document for each batch; a batch that is run again replaces its own folder, so results are whole."""

    def write(batch: DataFrame, number: int) -> None:
        report.risk(batch, rules.run_rules(segment(batch))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
