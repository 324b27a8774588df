"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: a record is a row, CRLF CRLF ends it. A payload seen before is a revisit of the row with the largest id.

Reading: the text reader cuts the archives at the record magic, in splits of any size. Each piece knows where it starts
(lengths are summed in a split, then over the splits of its file) and, from its Content-Length, where its successor starts.
Those candidate links are followed by pointer jumping from the start of each file; pieces that follow one another
without a gap are one step. What is not reached, such as a magic inside a payload, is no record but part of one.

Nothing but DataFrame functions is used. A text goes through a shuffle only where a payload holds the magic itself.

Defined cases: null html is an empty payload; a null url is an empty one, control characters and spaces in it are percent-
encoded; a page without id is a response and nothing refers to it; repeated rows of the largest id are all responses;
a record that its file ends before is left out; an empty table gives empty archives; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import few, kept
from barloom.session import checkpointed, fresh_path

MAGIC = "WARC/1.1\r\n"
STEP = len(MAGIC)
END = "\r\n\r\n"
NO_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of bytes; 5 hex digits are 4 base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archives of ``pages`` in the folder ``path``; payloads of fewer than ``least`` bytes are never revisits."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    again = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    again = kept(again.where("n > 1 and first is not null").select("digest", "first"), "again")
    rows = rows.join(few(again), "digest", "left")
    revisit = F.coalesce(F.col("id") != F.col("first"), F.lit(False)) & (F.octet_length("payload") >= least)
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END)
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {NO_DATE}\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("first")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _parsed(value: Column) -> dict[str, Column]:
    """What a piece (the text after a magic) says of its record."""
    head = F.substring_index(value, END, 1)
    field = lambda name, what: F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*{what}[ \t]*(?:\r\n|$)", 1), F.lit(""))
    return {
        "length": field("Content-Length", "([0-9]{1,18})").cast("long"), "head": F.octet_length(head).cast("long"), "size": F.octet_length(value).cast("long"),
        "type": field("WARC-Type", r"([^\r\n]*)"), "id": field("WARC-Record-ID", "<urn:page:(-?[0-9]{1,19})>").cast("long"),
        "refers": field("WARC-Refers-To", "<urn:page:(-?[0-9]{1,19})>").cast("long"),
        "claimed": field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})"),
        "http": F.octet_length(F.substring_index(value, END, 2)).cast("long"),
    }


def _payload(value: Column) -> Column:
    """The bytes after the HTTP header, of a piece whose record is all there."""
    return F.substring(value.cast("binary"), (F.col("http") + len(END) + 1).cast("int"), (F.col("head") + F.col("length") - F.col("http")).cast("int"))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, split, row, off (where the piece's magic is), next and what the piece says; ``whole`` if it is all of its record."""
    texts = spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    said = texts.select("file", "split", "bytes", "row", "value", *[c.alias(n) for n, c in _parsed(F.col("value")).items()])
    said = said.withColumn("whole", F.coalesce(F.col("size") == F.col("head") + F.col("length") + 2 * len(END), F.lit(False)))
    payload = F.when(F.col("whole") & (F.col("type") == "response"), _payload(F.col("value")))
    said = said.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("digest", base32_sha1(payload)).drop("value")
    order = Window.partitionBy("file", "split").orderBy("row")
    said = said.withColumn("__before", F.coalesce(F.sum(F.col("size") + STEP).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    said = kept(said, "pieces")
    splits = said.groupBy("file", "split").agg(F.sum(F.col("size") + STEP).alias("n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    placed = said.join(few(splits), ["file", "split"]).withColumn("off", F.col("__base") + F.col("__before") - STEP)
    placed = placed.where("off >= 0").drop("__base", "__before")  # before the first magic there is no record
    ends = F.col("off") + STEP + F.col("head") + F.col("length") + 2 * len(END)
    return placed.withColumn("next", F.when(ends <= F.col("bytes"), ends)).withColumn("whole", F.col("whole") & F.col("next").isNotNull())


def chained(found: DataFrame) -> DataFrame:
    """``found`` with ``run``, the offset of the first piece of its run, for runs that the file's start reaches, else null."""
    jumps = found.where("next is not null and not whole").select("file", F.col("next").alias("off")).distinct().withColumn("__target", F.lit(True))
    order = Window.partitionBy("file", "split").orderBy("off")
    found = found.join(jumps, ["file", "off"], "left")
    new = F.coalesce(F.lag("next").over(order) != F.col("off"), F.lit(True)) | F.coalesce("__target", F.lit(False))
    found = kept(found.withColumn("__run", F.max(F.when(new, F.col("off"))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__target"), "runs")
    runs = found.groupBy("file", F.col("__run").alias("off")).agg(F.max_by("next", "off").alias("to"))
    step = checkpointed(runs.withColumn("reached", F.col("off") == 0))
    before = -1
    while (now := step.agg(F.count(F.when(F.col("reached"), 1)), F.count("to")).first()) and now[1] and now[0] != before:
        before = now[0]
        # every pointer doubles; what a reached run points to is reached
        hit = step.where("reached and to is not null").select("file", F.col("to").alias("off")).distinct().withColumn("__hit", F.lit(True))
        far = step.select("file", F.col("off").alias("to"), F.col("to").alias("__far"))
        step = step.join(far, ["file", "to"], "left").join(hit, ["file", "off"], "left")
        step = checkpointed(step.select("file", "off", F.col("__far").alias("to"), (F.col("reached") | F.coalesce("__hit", F.lit(False))).alias("reached")))
    reached = step.where("reached").select("file", F.col("off").alias("__run"), F.col("off").alias("run"))
    return found.join(few(reached), ["file", "__run"], "left").drop("__run")


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, off, type, id, refers, claimed (the digest in the header), payload_bytes and digest (of a response's payload) of every record in the folder."""
    found = kept(chained(pieces(spark, path)), "chained")
    records = found.where("run is not null and next is not null")
    fields = ["file", "off", "type", "id", "refers", "claimed", "payload_bytes", "digest"]
    whole, broken = records.where("whole"), records.where("not whole")
    if broken.limit(1).count() == 0:
        return whole.select(fields)
    # the pieces of a record that holds the magic: those up to the next record of the file
    inside = Window.partitionBy("file", "split").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    own = found.withColumn("__own", F.max(F.when(F.col("run").isNotNull(), F.col("off"))).over(inside))
    last = found.groupBy("file", "split").agg(F.max(F.when(F.col("run").isNotNull(), F.col("off"))).alias("__last"))
    carried = last.select("file", "split", F.max("__last").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    own = own.join(few(carried), ["file", "split"]).withColumn("__own", F.coalesce("__own", "__carried"))
    ends = broken.select("file", F.col("off").alias("__own"), F.col("next").alias("__to"))
    parts = kept(own.join(ends, ["file", "__own"]).where("off < __to").select("file", F.col("__own").alias("off"), "row"), "parts")
    texts = spark.read.option("lineSep", MAGIC).text(path).select("value", F.monotonically_increasing_id().alias("row"))
    joined = texts.join(few(parts), "row").groupBy("file", "off").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("p"))
    joined = joined.select("file", "off", F.array_join("p.value", MAGIC).alias("value"))
    joined = joined.select("file", "off", "value", *[c.alias(n) for n, c in _parsed(F.col("value")).items()])
    payload = F.when(F.col("type") == "response", _payload(F.col("value")))
    joined = joined.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("digest", base32_sha1(payload))
    return whole.select(fields).unionByName(joined.select(fields))


def round_trip(pages: DataFrame, least: int = 0, path: str | None = None, **names: str) -> DataFrame:
    """Write ``pages``, read the archives back, and give each page what its record says; a revisit has its response's payload."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write(pages, path, least, **names)
    records = read(spark, path)
    responses = records.where("type = 'response'")
    first = responses.select(F.col("id").alias("refers"), "digest", "payload_bytes").distinct()
    revisits = records.where("type = 'revisit'").select(F.col("id").alias("page_id"), "refers", F.col("claimed").alias("digest")).join(first, ["refers", "digest"])
    revisits = revisits.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("refers").alias("refers_to"))
    return responses.select(
        F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    ).unionByName(revisits)
