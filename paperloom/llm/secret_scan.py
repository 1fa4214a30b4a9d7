"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its UTF-8 bytes. The ledger has rows of a blob, the rule versions
that have seen it (by name and version) and the spans that each of them found. It is a table that is only ever appended
to, so it outlives the session: a scan looks at those pairs of blob and rule version that it lacks, each blob once
however many paths and versions hold it, appends what it found, and joins the findings back to all rows. Findings are
those of the rules asked for, of each name its newest version, so an updated rule withdraws what the older one found.
All of it is DataFrame operations: the texts between the matches and the matches give the places, in code points.

Defined results: a null text counts as empty; repeated rows, equal texts and versions of a path get the findings of their
text each; very long texts are scanned whole; spans that start together are in the order of the rules; an entry that is in
the ledger twice (after a job that was run again) counts once; an empty table gives no rows; further columns, whatever
their names, are carried along by findings() and scan_history(), whose own column is _spans.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import materialise

RULE_KEY, SPAN = "struct<name:string,version:int>", "struct<start:int,end:int,name:string,version:int>"
LEDGER = f"blob binary, seen array<{RULE_KEY}>, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap; those whose ``group`` is under ``least`` long are dropped.

    ``hint`` is a cheaper pattern that a text with a match always has.
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: str | None = None

    @property
    def key(self) -> Column:
        return F.struct(F.lit(self.name).alias("name"), F.lit(self.version).alias("version"))


#: The base kinds, then those of this module. Dropping short runs of hex digits leaves what {16,} finds, and likewise for access keys.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"(?i)passw|secret|token|api_?key"),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", hint="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hint=r"gh[pousr]_"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
BASE = ("assign", "access", "hex")


def newest(rules: Sequence[Rule]) -> list[Rule]:
    """The rules asked for: of each name its highest version, in the order in which the names are first listed."""
    of_name: dict[str, Rule] = {}
    for rule in rules:
        if rule.name not in of_name or of_name[rule.name].version < rule.version:
            of_name[rule.name] = rule
    return [*of_name.values()]


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; an empty one if nothing was written there yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_ledger(spark)


def _address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _pieces(rule: Rule, wanted: Column) -> Column:
    """The lengths of the text before each match, of the match, and whether it counts; null if there is no match.

    split() and regexp_extract_all() walk through the same matches, so the two fit together.
    """
    text, pattern = F.col("text"), F.lit(rule.pattern)
    before = F.transform(F.split(text, rule.pattern, -1), F.length)
    match = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    held = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    rows = F.transform(match, lambda n, i: F.struct(rule.key.alias("rule"), i.alias("no"), F.get(before, i).alias("before"), n.alias("length"), (F.get(held, i) >= rule.least).alias("counts")))
    return F.when(wanted & text.rlike(rule.hint or rule.pattern), rows)


def pending(texts: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob, text and todo (the rule versions that have not seen it) of the blobs that some rule has to look at.

    ``texts`` has a column text; equal texts are merged before the shuffle.
    """
    blobs = texts.select(_address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    known = ledger.groupBy("blob").agg(F.flatten(F.collect_list("seen")).alias("seen"))
    asked = F.array(*(r.key for r in newest(rules))).cast(f"array<{RULE_KEY}>")
    todo = F.array_except(asked, F.coalesce("seen", F.array().cast(f"array<{RULE_KEY}>")))
    return blobs.join(known, "blob", "left").select("blob", "text", todo.alias("todo")).where("size(todo) > 0")


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blobs: blob, text and todo. Returns the ledger rows to add."""
    found = F.flatten(F.array_compact(F.array(*(_pieces(r, F.array_contains("todo", r.key)) for r in newest(rules)))))
    looked = materialise(blobs.select("blob", "todo", found.alias("pieces")), "scanned")
    pieces = looked.select("blob", F.explode("pieces").alias("p")).select("blob", "p.*")
    upto = Window.partitionBy("blob", "rule").orderBy("no")
    end = F.sum(F.col("before") + F.col("length")).over(upto).cast("int")
    span = F.struct((F.col("end") - F.col("length")).alias("start"), "end", "rule.name", "rule.version")
    spans = pieces.withColumn("end", end).where("counts").groupBy("blob").agg(F.collect_list(span).alias("spans"))
    return looked.join(spans, "blob", "left").select("blob", F.col("todo").alias("seen"), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def update_ledger(texts: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger lacks and return the whole ledger, without writing to it."""
    ledger = ledger if ledger is not None else empty_ledger(texts.sparkSession)
    return materialise(ledger.unionByName(scan_blobs(pending(texts, ledger, rules), rules)), "ledger")


def append_to_ledger(texts: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger at path lacks, append it there, and return the whole ledger. A failed job appends nothing."""
    spark = texts.sparkSession
    scan_blobs(pending(texts, read_ledger(spark, path), rules), rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def _kind(rules: Sequence[Rule], name: Column) -> Column:
    return F.array_position(F.array(*(F.lit(r.name) for r in rules)), name)


def findings(paths: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Join the ledger back to all rows of paths (any columns and text): _spans replaces text, in order of start and rule."""
    names = [f"`{c}`" for c in paths.columns if c not in ("text", "_spans")]
    rules = newest(rules)
    asked = F.array(*(r.key for r in rules)).cast(f"array<{RULE_KEY}>")
    own = F.filter(F.array_distinct(F.flatten(F.collect_list("spans"))), lambda s: F.array_contains(asked, F.struct(s["name"].alias("name"), s["version"].alias("version"))))
    ordered = F.transform(F.sort_array(F.transform(own, lambda s: F.struct(s["start"], _kind(rules, s["name"]).alias("kind"), s["end"], s["name"], s["version"]))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["name"].alias("name"), s["version"].alias("version")))
    # written before the join, so that a blob with very many paths can be split there
    entries = materialise(ledger.groupBy("blob").agg(ordered.alias("_spans")), "entries")
    row = F.struct(*names) if names else F.lit(0)
    keyed = paths.select(row.alias("row"), _address(F.col("text")).alias("blob"))
    joined = keyed.join(entries, "blob", "left")
    return joined.select("row.*", "_spans") if names else joined.select("_spans")


def scan_history(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every version of every path (any columns and text) with its spans; the ledger at path grows by what is new."""
    return findings(versions, append_to_ledger(versions, path, rules), rules)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    slim = docs.select("doc_id", "text")
    held = findings(slim, update_ledger(slim, ledger, rules), rules)
    count = lambda name: F.size(F.filter("_spans", lambda s: s["name"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter("_spans", lambda s: s["name"].isin(*BASE))
    return held.select("doc_id", *map(count, BASE), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("_spans")).alias("spans"))
