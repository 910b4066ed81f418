"""Web archive records: not-modified revisits are resolved against earlier full responses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kartograf.llm.base import NO_ID, stored, typed

#: Header fields that a 304 answer may update in a stored response (RFC 7232, section 4.1).  Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

RECORD = "record_id bigint, kind string, url string, date bigint, etag string, last_modified string, payload_digest string, headers map<string,string>"
_FIELDS = ["record_id", "kind", "date", "etag", "last_modified", "payload_digest", "headers", "canonical", "rank"]
_CARRIED = ["base_id", "base_date", "base_etag", "base_modified", "base_digest", "base_headers"]
_ROW = [*_FIELDS, "place", "first", *_CARRIED, "pid", "open"]
_BASE = "base_id bigint, base_date bigint, base_etag string, base_modified string, base_digest string, base_headers string"


def canonical_url(url: Column) -> Column:
    """Address without scheme, ``www.``, default port, fragment, tracking parameters and last slash; host in lower case."""
    text = F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)#.*$", "")
    text = F.regexp_replace(text, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(text, r"(?s)^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(text, r"(?s)^[^/?]*(.*)$", 1), r"([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), r"\?&", "?")
    return F.concat(host, F.regexp_replace(rest, r"[/?&]+$", ""))


def _as_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted partition: each record with the last response of its address that this partition has seen."""
    pid, address, first, base, none = TaskContext.get().partitionId(), None, None, None, (None,) * 6
    whole = {"record_id", "date", "rank", "base_id", "base_date"}
    frame = lambda rows: typed(rows, _ROW, whole)
    for batch in batches:
        rows = []
        for r in zip(*(batch[c].tolist() for c in _FIELDS)):
            r = tuple(None if v == NO_ID else v for v in r)
            record, kind, date, etag, modified, digest, headers, canonical, _ = r
            if address is None or canonical != address:
                first = canonical if first is None else first
                address, base = canonical, None
            rows.append((*r, "record", None, *(base or none), pid, base is None and address == first))
            if kind == "response":
                base = (record, date, etag, modified, digest, headers)
        yield frame(rows)
    if address is not None:
        yield frame([(None, None, None, None, None, None, None, address, None, "end", first, *(base or none), pid, False)])


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, kind, canonical, date, base_id, state, headers, payload_digest), one row per record.

    The base of a revisit is the latest response of the same canonical address with a strictly
    earlier date; of several at one date, the one with the largest id.  Entity tags decide if both
    have one (weak marks are ignored), else modification dates, else payload digests.  ``state``:
    ``response`` for a response, ``resolved``, ``mismatch`` where a validator differs, ``unverified``
    where there is none in common, ``missing`` without an earlier response.  Resolved and unverified
    revisits get the base's headers (JSON, names in lower case and in order), overlaid with those
    fields that a 304 answer may update, and the base's digest; other revisits keep their own.  NULL
    addresses are one empty address; records without date come first; repeated records are records.
    Kinds besides ``response`` are taken as revisits.  Further columns are not read.

    Records are sorted by address and date into ranges, so an address with a third of all records is
    many partitions; only one state per partition passes from range to range.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]
    low = F.transform_values(F.map_from_entries(F.array_distinct(F.transform(
        F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.coalesce(e["value"], F.lit("")).alias("value"))))), lambda k, v: v)
    ordered_map = F.map_from_entries(F.array_sort(F.map_entries(low)))
    rows = records.select(*names).withColumn("canonical", canonical_url(F.col("url"))).withColumn("headers", F.to_json(ordered_map)).drop("url")
    rows = rows.withColumn("rank", (F.col("kind").eqNullSafe("response")).cast("int"))
    keys = ["canonical", "date", "rank", "record_id"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(NO_ID)) for c in ("record_id", "date")})
    spread = rows.select(*_FIELDS).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = ("record_id bigint, kind string, date bigint, etag string, last_modified string, payload_digest string, headers string, canonical string, rank int, "
              f"place string, first string, {_BASE}, pid int, open boolean")
    done = stored(spread.mapInPandas(_as_of, schema), "records")
    # one row per partition: what it knows of its last address, and what the next ones may ask of their first
    ends = done.filter("place = 'end'")
    state = F.when(F.col("base_id").isNotNull(), F.struct(*_CARRIED))
    asked = ends.select("pid", F.col("first").alias("address"), F.lit(0).alias("side"), F.lit(None).cast(f"struct<{_BASE.replace(' ', ':').replace(',:', ',')}>").alias("state"))
    told = ends.select("pid", F.col("canonical").alias("address"), F.lit(1).alias("side"), state.alias("state"))
    before = W.partitionBy("address").orderBy("pid", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = asked.union(told).withColumn("before", F.last("state", True).over(before)).filter("side = 0 AND before IS NOT NULL").select(
        F.col("pid").alias("_pid"), F.col("before").alias("_before"))
    rest = done.filter("place = 'record'")
    closed = rest.filter("NOT open").select("record_id", "kind", "canonical", "date", "etag", "last_modified", "payload_digest", "headers", *_CARRIED)
    opened = rest.filter("open").join(stored(carried, "carried"), F.col("pid") == F.col("_pid"), "left").select(
        "record_id", "kind", "canonical", "date", "etag", "last_modified", "payload_digest", "headers", *[F.col(f"_before.{c}").alias(c) for c in _CARRIED])
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    state = (F.when(F.col("kind").eqNullSafe("response"), "response").when(F.col("base_id").isNull(), "missing")
             .when(both("etag", "base_etag"), F.when(tag("etag") == tag("base_etag"), "resolved").otherwise("mismatch"))
             .when(both("last_modified", "base_modified"), F.when(F.col("last_modified") == F.col("base_modified"), "resolved").otherwise("mismatch"))
             .when(both("payload_digest", "base_digest"), F.when(F.col("payload_digest") == F.col("base_digest"), "resolved").otherwise("mismatch"))
             .otherwise("unverified"))
    out = closed.union(opened).withColumn("state", state)
    taken = F.col("state").isin("resolved", "unverified")
    as_map = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), "map<string,string>")
    update = F.map_filter(as_map(F.col("headers")), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(as_map(F.col("base_headers")), lambda k, v: ~F.array_contains(F.map_keys(update), k))
    merged = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, update)))))
    return out.select("record_id", "kind", "canonical", "date", F.when(F.col("state") != "response", F.col("base_id")).alias("base_id"), "state",
                      F.when(taken, merged).otherwise(F.col("headers")).alias("headers"),
                      F.when(taken, F.coalesce("base_digest", "payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"))


def page_records(pages: DataFrame) -> DataFrame:
    """Records of a crawl that visited every page and asked again later.

    A page is a response at minute ``page_id``; 40,000 minutes later the same address is asked again
    under another scheme and fragment, with the validators of that response, and a third request
    comes a minute before the page was seen.  Every third page sends no entity tag, every fifth no
    modification date.
    """
    p = F.col("page_id")
    html = F.coalesce("html", F.lit(""))
    etag = F.when(p % 3 != 0, F.concat(F.lit('"'), F.md5(html), F.lit('"')))
    modified = F.when(p % 5 != 0, F.concat(F.lit("day "), F.length(html).cast("string")))
    header = lambda kind, at: F.map_filter(F.create_map(
        F.lit("Date"), at.cast("string"), F.lit("ETag"), etag, F.lit("Content-Type"), F.when(F.lit(kind == "response"), F.lit("text/html")).otherwise(F.lit("none")),
        F.lit("Content-Length"), F.when(F.lit(kind == "response"), F.length(html).cast("string")).otherwise(F.lit("0")),
        F.lit("Expires"), (at + 60).cast("string")), lambda k, v: v.isNotNull())
    def record(number: int, kind: str, url: Column, at: Column, weak: bool) -> DataFrame:
        return pages.select((p * 3 + number).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), at.alias("date"),
                            (F.concat(F.lit("W/"), etag) if weak else etag).alias("etag"), modified.alias("last_modified"),
                            (F.sha2(html, 256) if kind == "response" else F.lit(None).cast("string")).alias("payload_digest"), header(kind, at).alias("headers"))
    again = F.concat(F.regexp_replace("url", "^https?://", "HTTP://"), F.lit("#again"))
    return record(0, "response", F.col("url"), p * 60, False).union(record(1, "revisit", again, p * 60 + 2_400_000, True)).union(
        record(2, "revisit", F.col("url"), p * 60 - 60, False))
