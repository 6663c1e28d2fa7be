"""Explicit schemas of every table the engine reads or writes."""

from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "BINARY": T.BinaryType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """A schema from ``name TYPE, ...``; needs no session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RULES = _schema(
    "filter_ord INT, nome STRING, secao STRING, orgao STRING, keywords ARRAY<STRING>"
)
LISTING = _schema("edition_date DATE, body STRING")
FILES = _schema("file_name STRING, secao STRING, edition_date DATE, path STRING, length BIGINT")
ENTRY_INDEX = _schema(
    "file_name STRING, secao STRING, edition_date DATE, path STRING, entry_no BIGINT, part BIGINT, err STRING"
)
ENTRIES = _schema(
    "file_name STRING, secao STRING, edition_date DATE, entry_no BIGINT, xml STRING, err STRING"
)
BINARY_FILES = _schema(
    "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
)
PAGES = _schema(
    "file_name STRING, secao STRING, edition_date DATE, page_no BIGINT, text STRING"
)
DOCUMENTS = _schema("file_name STRING, secao STRING, edition_date DATE, text STRING")
# Lines may also have ``from_line`` and ``to_line``, the limits of their entry.
LINES = _schema(
    "file_name STRING, secao STRING, edition_date DATE, n_lines BIGINT, line_no BIGINT, line STRING"
)

# Stored tables. ``run_id`` names the attempt that wrote a row and is the unit of replay.
MATCHES = _schema(
    "id BIGINT, filter_ord INT, filter_name STRING, source_file STRING, keyword_ord INT, keyword_hit STRING, "
    "line_no BIGINT, publication_title STRING, publication_date STRING, text_snippet STRING, "
    "full_text STRING, created_ts TIMESTAMP, run_id STRING, edition_date DATE"
)
# ``file_date`` is the day in the file's name, whatever day it was listed for.
LEDGER = _schema("file_name STRING, processed_date DATE, processed_ts TIMESTAMP, run_id STRING, file_date DATE")
QUARANTINE = _schema("file_name STRING, edition_date DATE, err STRING, run_id STRING")
RUNS = _schema(
    "id BIGINT, run_ts TIMESTAMP, run_date DATE, files_processed BIGINT, matches_found BIGINT, "
    "email_sent INT, notes STRING, run_id STRING"
)
# Matches of a day put together from the folders of its runs.
DAYS = T.StructType([f for f in MATCHES.fields if f.name != "edition_date"] + [
    T.StructField("edition_date", T.DateType()), T.StructField("version", T.IntegerType())
])
DIGESTS = _schema(
    "run_date DATE, n_matches BIGINT, subject STRING, head STRING, foot STRING, run_id STRING"
)
DIGEST_ITEMS = _schema("run_date DATE, n BIGINT, block STRING, run_id STRING")
