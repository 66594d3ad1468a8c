"""Secret scans over versioned texts with an incremental ledger of blobs, in DataFrame functions only.

Every version of a file is a blob, addressed by the SHA-256 of its content. A
ledger in shared storage says which (blob, rule version) pairs were scanned and
what was found. A run scans only pairs that the ledger does not have, appends
its findings, and joins all findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arrays import let, positions, running_totals
from tessera.sources.columns import Carried
from tessera.sources.shared import Scratch, shared_path, stage


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the number of characters that group ``group`` must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The base kinds in their order, then the kinds added here.
#: For runs of one class of characters a least length inside the pattern equals dropping short matches later.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = ("assign", "access", "hex")
SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


@dataclass(frozen=True)
class Ledger:
    """Folder of the ledger: ``scanned`` has the pairs, ``findings`` the spans of those that have any."""

    path: str

    @property
    def scanned(self) -> str:
        return f"{self.path}/scanned"

    @property
    def findings(self) -> str:
        return f"{self.path}/findings"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches of a rule as (start, rank, kind, stop), in code points.

    The text between the matches comes from splitting at the pattern, so the start of match i is the length of the first
    i + 1 pieces and i matches: running totals of lengths, in which no match copies what the earlier ones found.
    """

    def over(pieces: Column, matches: Column, secrets: Column) -> Column:
        lengths = F.flatten(F.transform(matches, lambda m, i: F.array(*(F.char_length(x).cast("bigint") for x in (F.get(pieces, i), m)))))
        long = F.filter(positions(secrets), lambda i: F.char_length(F.get(secrets, i)) >= rule.least)
        return let(running_totals(lengths), lambda at: F.transform(long, lambda i: span(F.get(at, 2 * i + 1), F.get(at, 2 * i + 2))))

    def span(start: Column, stop: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))

    def matched(pieces: Column) -> Column:
        matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        if not rule.group:
            return let(matches, lambda m: over(pieces, m, m))
        secrets = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        return let(matches, lambda m: let(secrets, lambda s: over(pieces, m, s)))

    return let(F.split(text, rule.pattern), lambda pieces: F.when(F.size(pieces) > 1, matched(pieces)).otherwise(F.array().cast(SPAN)))


def blobs(versions: DataFrame) -> DataFrame:
    """(blob, text) with each content once; a null text is empty."""
    body = versions.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return body.select(F.sha2("text", 256).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the ledger, empty where nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        kinds = [field.split(" ", 1) for field in schema.split(", ")]
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in kinds))
    return spark.read.schema(schema).parquet(path)


def scanned_pairs(spark: SparkSession, ledger: Ledger) -> DataFrame:
    return _read(spark, ledger.scanned, "blob string, kind string, version int")


def findings(spark: SparkSession, ledger: Ledger) -> DataFrame:
    return _read(spark, ledger.findings, f"blob string, kind string, version int, spans {SPAN}")


def _current(rules: tuple[Rule, ...]) -> Column:
    """Rows of the ledger that belong to one of ``rules`` in its present version."""
    return F.struct("kind", "version").isin(*(F.struct(F.lit(r.kind), F.lit(r.version)) for r in rules))


def scan_new(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the (blob, rule version) pairs of ``versions`` that the ledger lacks, and append to it.

    Rules that have scanned the same blobs so far are tried together. Findings
    are written before the pairs that vouch for them, and readers match both;
    a run that dies in between is simply done again.
    """
    spark = versions.sparkSession
    known = scanned_pairs(spark, ledger).where(_current(rules))
    done = known.groupBy("blob").agg(F.collect_set("kind").alias("kinds"))
    fresh = blobs(versions).join(done, "blob", "left").where(F.col("kinds").isNull() | (F.size("kinds") < len(rules)))
    kinds = F.coalesce(F.col("kinds"), F.array().cast("array<string>"))
    results = fresh.select(
        "blob",
        F.explode(
            F.filter(
                F.array(
                    *(
                        F.when(
                            ~F.array_contains(kinds, rule.kind),
                            F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), spans_of(F.col("text"), rule, rank).alias("spans")),
                        )
                        for rank, rule in enumerate(rules)
                    )
                ),
                lambda r: r.isNotNull(),
            )
        ).alias("r"),
    ).select("blob", "r.*")
    with Scratch(spark) as scratch:
        new = scratch.stage(results, "scan")
        new.where(F.size("spans") > 0).hint("rebalance").write.mode("append").parquet(ledger.findings)
        new.select("blob", "kind", "version").write.mode("append").parquet(ledger.scanned)


def findings_by_path(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of ``versions`` without text, with ``found``: spans of the rules by start, then order of the rules.

    Rows without findings have an empty list; a null text is an empty one, long
    texts are scanned whole. Rows of equal text, repeated ones too, share their
    findings; the join on a blob of very many paths can be split. An empty table
    stays empty. A column found is replaced, all others pass under any name.
    """
    spark = versions.sparkSession
    own = (
        findings(spark, ledger)
        .where(_current(rules))
        .dropDuplicates(["blob", "kind", "version"])
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))
    )
    carried = Carried(versions, ["text"], ["found"])
    paths = carried.df.withColumn("blob", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).drop("text")
    # both are plain exchanges, since the findings are a table
    joined = paths.join(stage(own, "found"), "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(SPAN)))
    return carried.back(joined, "found", without=["text"])


def spans_text(found: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
