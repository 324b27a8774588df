"""Secret scans with an incremental ledger of blobs.

Every version of a document is a blob, addressed by the SHA-256 of its text. The ledger holds the (blob, kind, version)
pairs scanned so far; a scan looks only at blobs with a pair not in it, writes what it finds, then the pairs (in this
order, so a run that dies is repeated rather than skipped), and the findings are joined back to every document and
every version that holds the blob. Raising the version of a rule scans all blobs again for that rule alone.

Everything is DataFrame functions. A place is found from the lengths of the matches and of the texts between them; places
count code points, the end is exclusive.

Defined cases: a null text is an empty one, and an empty one has no findings; equal texts are scanned once; repeated
rows and null ids keep their rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import kept, text_of
from barloom.session import fresh_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched left to right; a match counts if its group ``value`` has ``least`` characters.

    ``hint`` matches every text that ``pattern`` matches in such a way; only texts with it are taken apart.
    """

    kind: str
    version: int
    pattern: str
    value: int
    least: int
    hint: str


RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)
FINDINGS = "blob string, kind string, version int, start int, end int"


def blob_of(text: str) -> Column:
    return F.sha2(text_of(text), 256)


def _places(text: Column, rule: Rule) -> Column:
    """The (start, end) of the rule's findings in a text."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value))
    lengths = F.arrays_zip(
        F.transform(between, F.length).alias("between"), F.transform(whole, F.length).alias("whole"), F.transform(value, F.length).alias("value")
    )
    lengths = F.filter(lengths, lambda x: x["whole"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["between"]
        end = begin + x["whole"]
        new = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["value"] >= rule.least, F.concat(acc["found"], new)).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(rule.hint), F.aggregate(lengths, start, step, lambda acc: acc["found"]))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, pairs) of the ``blobs`` (blob, text) for the rules that ``done`` (blob, kind, version) lacks.

    ``blobs`` may repeat a blob.
    """
    blobs = blobs.dropDuplicates(["blob"])
    if done is None:
        blobs = blobs.withColumn("__done", F.expr("cast(array() as array<string>)"))
    else:
        had = done.groupBy("blob").agg(F.collect_set(F.concat_ws("/", "kind", "version")).alias("__done"))
        blobs = blobs.join(had, "blob", "left").withColumn("__done", F.coalesce("__done", F.expr("cast(array() as array<string>)")))
        blobs = blobs.where(F.size(F.array_except(F.array(*[F.lit(f"{r.kind}/{r.version}") for r in rules]), "__done")) > 0)

    def of(rule: Rule) -> Column:
        new = ~F.array_contains("__done", f"{rule.kind}/{rule.version}")
        return F.when(new, F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), _places(F.col("text"), rule).alias("places")))

    scanned = blobs.select("blob", F.explode(F.array_compact(F.array(*map(of, rules)))).alias("__r"))
    scanned = kept(scanned.select("blob", "__r.kind", "__r.version", "__r.places"), "scanned")
    findings = scanned.select("blob", "kind", "version", F.explode("places").alias("p")).select("blob", "kind", "version", "p.start", "p.end")
    return findings, scanned.select("blob", "kind", "version")


def update(docs: DataFrame, store: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger in the folder ``store`` lacks, append to it, and return all findings of these rules."""
    spark = docs.sparkSession
    blobs = docs.select(blob_of(text).alias("blob"), text_of(text).alias("text"))
    done = _stored(spark, f"{store}/pairs", "blob string, kind string, version int")
    findings, pairs = scan(blobs, rules, done)
    findings.write.mode("append").parquet(f"{store}/findings")
    pairs.write.mode("append").parquet(f"{store}/pairs")
    # a run that died between the two writes leaves findings that the next one finds again
    all_found = spark.read.schema(FINDINGS).parquet(f"{store}/findings").distinct()
    return all_found.where(F.concat_ws("/", "kind", "version").isin([f"{r.kind}/{r.version}" for r in rules]))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at ``path``, None where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if exists else None


def spans_by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings: ``spans``, structs of start, order of the kind, end and kind, sorted."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    span = F.struct("start", order[F.col("kind")].alias("order"), "end", "kind")
    return findings.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def find(docs: DataFrame, store: str | None = None, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``blob`` and ``spans`` (null: none) of every row; without a ``store`` the ledger starts empty."""
    store = store or fresh_path(docs.sparkSession, "ledger")
    spans = spans_by_blob(update(docs, store, rules, text), rules)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), blob_of(text).alias("blob")).join(spans, "blob", "left").select("doc_id", "blob", "spans")


def redact(docs: DataFrame, store: str | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mask``; overlapping findings are masked as one."""
    store = store or fresh_path(docs.sparkSession, "ledger")
    spans = spans_by_blob(update(docs, store, rules, text), rules).withColumnsRenamed({"blob": "__blob", "spans": "__spans"})
    rows = docs.withColumn("__blob", blob_of(text)).join(spans, "__blob", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def close(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))

    masked = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.aggregate("__spans", start, step, close))
    return rows.withColumn(text, masked).drop("__blob", "__spans").select(docs.columns)
