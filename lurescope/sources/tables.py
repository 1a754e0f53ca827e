"""Readers for the input tables, with explicit schemas (never inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

SCAN_REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("client_id", T.LongType()),
    T.StructField("url", T.StringType()),
])

DNS_RECORD_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("rtype", T.StringType()),
    T.StructField("rdata", T.StringType()),
])

#: DNS answers with their time: the records of one (domain, observed_at) are one answer set.
DNS_OBSERVATION_SCHEMA = T.StructType([*DNS_RECORD_SCHEMA.fields, T.StructField("observed_at", T.TimestampType())])

WHOIS_RECORD_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("creation_date", T.ArrayType(T.TimestampType())),
    T.StructField("registrars", T.ArrayType(T.StringType())),
    T.StructField("org", T.ArrayType(T.StringType())),
])

TLS_OBSERVATION_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("issuer", T.MapType(T.StringType(), T.StringType())),
    T.StructField("subject", T.MapType(T.StringType(), T.StringType())),
    T.StructField("not_after", T.StringType()),
])

_SCHEMAS = {"pages": PAGES_SCHEMA, "events": EVENTS_SCHEMA}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in _SCHEMAS:
        reader = reader.schema(_SCHEMAS[name])
    return reader.parquet(table_path(sf_dir, name))


def read_scan_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A collected request table ``(request_id, ts, client_id, url)``."""
    return spark.read.schema(SCAN_REQUEST_SCHEMA).format(fmt).load(path)


#: The column that keeps a line which isn't a request.
CORRUPT = "_corrupt"


def read_json_requests(spark: SparkSession, path: str, stream: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """S1 as JSON lines: the request columns, and ``_corrupt`` with the whole line where it can't be read as one."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    schema = T.StructType([*SCAN_REQUEST_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_dns_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Collected DNS answers ``(domain, rtype, rdata)``."""
    return spark.read.schema(DNS_RECORD_SCHEMA).format(fmt).load(path)


def read_dns_observations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S7 with a time: DNS answer sets as they were observed (for ``asof.enrich_at_request_time``)."""
    return spark.read.schema(DNS_OBSERVATION_SCHEMA).format(fmt).load(path)


def read_whois_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Collected WHOIS observations; dates, registrars and owners as lists (the first one counts)."""
    return spark.read.schema(WHOIS_RECORD_SCHEMA).format(fmt).load(path)


def read_tls_observations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Collected TLS handshake observations; issuer and subject as attribute maps."""
    return spark.read.schema(TLS_OBSERVATION_SCHEMA).format(fmt).load(path)
