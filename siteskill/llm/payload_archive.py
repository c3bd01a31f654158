"""Content-addressed WARC archive: payload bytes once per digest, exact record headers beside them, records by join.

`write` stores two tables: `payloads` (key = SHA-256 of the bytes, payload) with every different payload once,
and `headers` (page_id, key, header) with the exact header bytes of each record. The digest is verified twice: when
payloads meet under one key their lengths and SHA-1 must agree, and when they are read their SHA-256 must be the key.
`records` joins both to the original records; `read_back` parses the headers and checks them against the payloads.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is the response and the
others are revisits without content that refer to it; smaller payloads always make responses.

Edge cases: null html is an empty payload; a null url has no WARC-Target-URI line, line breaks in a url are
percent-encoded; repeated rows that share the largest page_id are all responses; a null page_id is written as `null` and
read back as null, it is a response only if no row of the group has a page_id; other columns are
ignored; an empty table makes an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

LEAST = 1000
END = "\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    headers: DataFrame
    payloads: DataFrame


def _header(owner: Column, least: int) -> Column:
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = (F.col("bytes") >= least) & owner.isNotNull() & ~F.col("page_id").eqNullSafe(owner)
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")), F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(owner))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END)).cast("binary")


def write(pages: DataFrame, least: int = LEAST) -> Archive:
    """Both tables, written to the shared folder."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"key": F.sha2("payload", 256), "sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("bigint")}
    )
    same = (F.min("sha1") == F.max("sha1")) & (F.min("bytes") == F.max("bytes"))
    stored = rows.groupBy("key").agg(F.first("payload").alias("payload"), same.alias("same")).select(
        "key", F.when(F.col("same"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads under one digest"))).alias("payload")
    )
    narrow = stage(rows.drop("payload"), "warc_rows")
    owners = stage(narrow.where(F.col("bytes") >= least).groupBy("key").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc_owners")
    headers = narrow.join(owners, "key", "left").select("page_id", "key", _header(F.col("owner"), least).alias("header"))
    return Archive(stage(headers, "warc_headers"), stage(stored, "warc_payloads"))


def _field(name: str, pattern: str = "[^\r]*") -> Column:
    return F.regexp_extract(F.col("header").cast("string"), f"\r\n{name}: ({pattern})\r\n", 1)


def records(archive: Archive) -> DataFrame:
    """page_id and the original bytes of every record."""
    payload = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    whole = F.concat(F.col("header"), payload, F.lit(END.encode()))
    return archive.headers.join(archive.payloads, "key").select("page_id", whole.alias("record"))


def read_back(archive: Archive) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, as the stored headers and payloads have them."""
    facts = archive.payloads.select(
        "key", (F.sha2("payload", 256) == F.col("key")).alias("sound"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("bytes")
    )
    kind, said = _field("WARC-Type"), _field("WARC-Payload-Digest", "sha1:[0-9a-f]*")
    length = F.when(kind == "revisit", F.lit(0)).otherwise(F.col("bytes"))
    sound = F.coalesce(F.col("sound"), F.lit(False)) & (said == F.concat(F.lit("sha1:"), F.col("sha1"))) & (_field("Content-Length").cast("bigint") == length)
    page = lambda name: F.regexp_extract(_field(name), "<urn:page:(-?[0-9]+)>", 1)
    numbered = lambda name: F.when(page(name) != "", page(name).cast("bigint"))
    url = F.when(F.col("header").cast("string").contains("\r\nWARC-Target-URI: "), _field("WARC-Target-URI"))
    return archive.headers.join(facts, "key", "left").select(
        numbered("WARC-Record-ID").alias("page_id"), url.alias("url"),
        F.when(sound, F.col("bytes")).otherwise(F.raise_error(F.lit("a stored record fails its digest")).cast("bigint")).alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"), kind.alias("record_type"), F.when(kind == "revisit", numbered("WARC-Refers-To")).alias("refers_to"),
    )
