"""Topics as bounded tables: what a topic holds when the read starts, with ``__key`` and ``__publish_time``.

Needs a Pulsar client, which this environment does not have; the reader is registered only where it imports.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class TopicReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.names = options, [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        import pulsar

        client = pulsar.Client(self.options["service"])
        try:
            return [InputPartition(p) for p in client.get_topic_partitions(self.options["topic"])]
        finally:
            client.close()

    def read(self, partition: InputPartition):
        import pulsar

        client = pulsar.Client(self.options["service"])
        try:
            reader = client.create_reader(partition.value, pulsar.MessageId.earliest)
            while reader.has_message_available():
                m = reader.read_next()
                payload = json.loads(m.data()) | {"__key": m.partition_key(), "__publish_time": m.publish_timestamp()}
                yield tuple(payload.get(n) for n in self.names)
        finally:
            client.close()


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic"

    def reader(self, schema) -> TopicReader:
        return TopicReader(self.options, schema)


def read_topic(spark: SparkSession, service: str, topic: str, schema: str) -> DataFrame:
    """A bounded read; a payload that does not decode fails the query."""
    try:
        import pulsar  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("no Pulsar client is installed") from e
    spark.dataSource.register(TopicSource)
    return spark.read.format("topic").schema(f"{schema}, __key string, __publish_time bigint").option("service", service).option("topic", topic).load()
