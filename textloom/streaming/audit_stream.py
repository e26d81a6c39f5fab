"""The audit of a stream of documents: stateless, so every micro-batch is final."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.audit import candidates, decided


def feature_stream(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, n_tokens, n_structure) of a batch or stream of documents (doc_id, text)."""
    t = T.tokens(F.col("text"))
    return docs.select("doc_id", T.character_density(F.col("text")).alias("h1"), F.size(t).alias("n_tokens"), F.size(T.structure_features(t)).alias("n_structure"))


def start_audit(docs: DataFrame, path: str, checkpoint: str, lang: str = "en", tags: DataFrame | None = None):
    """Writes the decided candidates of each micro-batch of `docs` to `path` as Parquet; returns the query.

    Candidates are numbered within their document, for which a window is needed: it runs inside each micro-batch. A batch
    that is tried again writes to the same folder of its number, so candidates are there once.
    """

    def write(batch: DataFrame, n: int) -> None:
        decided(candidates(batch, lang), tags, lang).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
