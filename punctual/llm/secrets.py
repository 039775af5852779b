r"""Secret scans by an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text). A ledger says which pairs of blob
and rule version have been scanned, with what they gave. A run scans only the missing pairs, each blob once
however many paths or versions hold it, adds them to the ledger and joins the ledger's findings back to all
paths.

Only built-in functions: matches come from ``regexp_extract_all``, the gaps between them from ``split`` by
the same pattern, and running sums of both lengths give the places, in code points, end exclusive.

Null text counts as empty; empty texts have a blob and no findings; repeated rows, null paths and further
columns of the versions table are kept as they are; an empty table gives empty results. The whole text is
scanned, whatever its length. Texts are equal if their bytes are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from punctual.llm.common import stored

#: Up to so many unseen blobs (about 100 bytes each) are broadcast to the texts; for more, texts are shuffled by blob.
BROADCAST_BLOBS = 200_000
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
LEDGER = f"blob string, rule string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if the group is long enough. ``hints``: one of these strings is in every match."""

    kind: str
    pattern: str
    hints: tuple[str, ...]
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules.
BASE = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ("password", "passwd", "secret", "token", "apikey", "api_key"), group=2, least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", ("akia",), least=18),
    # A run of hex digits is one match, so its least length can stand in the pattern.
    Rule("hex", r"[0-9a-f]{16,}", (), least=16),
)
# Well-known public token formats.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", ("private key",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", ("aiza",)),
)
RULES = BASE + MORE


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def find_spans(text: Column, rule: Rule, number: int) -> Column:
    """All leftmost non-overlapping matches that pass the rule, in order."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    none = F.array().cast(SPANS)

    def add(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        # After the last gap comes no match.
        taken = part["hit"].isNotNull() & (F.length(part["value"]) >= rule.least)
        spans = F.when(taken, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.cast(SPANS).alias("spans"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda done: done["spans"])
    low = F.lower(text)
    hinted = text.rlike(rule.pattern)
    if rule.hints:
        some = low.contains(rule.hints[0])
        for hint in rule.hints[1:]:
            some = some | low.contains(hint)
        hinted = some & hinted
    return F.when(hinted, found).otherwise(none)


def scan_unseen(versions: DataFrame, text: str, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: one per unseen pair of blob and rule version.

    Of the texts, only those with an unseen pair are shuffled; of the others only the hashes are compared with the ledger.
    """
    blobs = versions.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    if ledger is not None:
        ids = [rule.id for rule in rules]
        complete = ledger.where(F.col("rule").isin(ids)).groupBy("blob").agg(F.count_distinct("rule").alias("n")).where(F.col("n") == len(set(ids)))
        unseen = stored(blobs.select("blob").distinct().join(complete, "blob", "left_anti"))
        few = unseen.count() <= BROADCAST_BLOBS
        blobs = blobs.join(F.broadcast(unseen) if few else unseen, "blob", "left_semi")
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    scanned = [
        F.when(
            ~F.array_contains("seen", rule.id),
            F.struct(F.lit(rule.id).alias("rule"), find_spans(F.col("text"), rule, number).alias("spans")),
        )
        for number, rule in enumerate(rules)
    ]
    return (
        blobs.select("blob", F.array_compact(F.array(*scanned)).alias("scans"))
        .select("blob", F.explode("scans").alias("scan"))
        .select("blob", "scan.rule", "scan.spans")
    )


def path_findings(versions: DataFrame, text: str, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` (its text replaced by its ``blob``) with all ``spans`` of its blob, by place and kind."""
    current = ledger.where(F.col("rule").isin([r.id for r in rules]) & (F.size("spans") > 0))
    # Stored apart, so that the join has nothing but two shuffles below it and Spark can split a blob with many paths.
    by_blob = stored(current.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")))
    paths = versions.withColumn("blob", blob_id(F.col(f"`{text}`"))).drop(text, "spans")
    return paths.join(by_blob, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def written_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
