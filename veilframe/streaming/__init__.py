"""Extension: the codec on Structured Streaming. It keeps no state, so any source, sink and trigger works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from veilframe.operators.codec import encrypt
from veilframe.plans.spec import EntitySpec
from veilframe.sources.keys import KeyProvider


def encrypted_stream(stream: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str) -> DataFrame:
    """A streaming DataFrame in stored form, under the version that is current when the query starts."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return encrypt(stream, spec, provider, tenant)


def stream_to_parquet(stream: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the stored form; the file sink's log makes each batch appear once."""
    return encrypted_stream(stream, spec, provider, tenant).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
