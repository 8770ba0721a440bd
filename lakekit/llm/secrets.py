"""Secret scans with a ledger of blobs.

A text is a blob, addressed by its SHA-256, whatever and however many paths hold it. The ledger says
which rule versions a blob has been scanned with and what they found. A scan looks only at pairs of
blob and rule version that the ledger does not have, adds them to it, and joins the findings of all
blobs back to every path. Everything is made of built-in expressions.

A rule's matches are found leftmost first and without overlap. Their places come from cutting the
text at the matches: the lengths of what lies between them and of the matches add up. Null text is
an empty blob. Rows are kept as they are, repeated ones and null ids included; an empty table gives
an empty result and leaves the ledger as it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import free_names

LEDGER = "blob string, scanned array<string>, spans array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has `least` characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules. Runs of one character class that are too short for `hex` and
# `access` hold no longer match inside, so their least length is part of the pattern.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Common published token shapes.
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login", r"://[^\x20\x09-\x0D:/@]{1,128}:[^\x20\x09-\x0D:/@]{3,128}@"),
)
RULES = BASE + MORE


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per blob and scan: rule versions scanned with, and the spans found; empty if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def _cuts(text: Column, rule: Rule) -> Column:
    """For every match of a rule: kind, number, length of the text since the last match, own length, whether it counts."""
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    zipped = F.arrays_zip(between.alias("gap"), matches.alias("match"), values.alias("value"))
    cut = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(rule.kind).alias("kind"),
            i.alias("number"),
            F.length(z["gap"]).cast("bigint").alias("gap"),
            F.length(z["match"]).cast("bigint").alias("length"),
            (F.length(z["value"]) >= rule.least).alias("counts"),
        ),
    )
    return F.filter(cut, lambda c: c["length"].isNotNull())


def find(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`(blob, scanned, spans)` of `(blob, todo, text)`, one row per blob; `todo` names the rules to run.

    Spans are sorted by start, then by the rules' order. The rows should come distributed by blob, as
    a grouping by it leaves them; then nothing moves.
    """
    nothing = "array<struct<kind:string,number:int,gap:bigint,length:bigint,counts:boolean>>"
    found = [
        F.when(F.array_contains("todo", r.key) & F.col("text").rlike(r.pattern), _cuts(F.col("text"), r))
        .otherwise(F.array().cast(nothing))
        for r in rules
    ]
    cuts = blobs.select("blob", "todo", F.explode_outer(F.concat(*found)).alias("c")).select("blob", "todo", "c.*")
    before = Window.partitionBy("blob", "kind").orderBy("number")
    end = F.sum(F.col("gap") + F.col("length")).over(before)
    order = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    placed = cuts.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    span = F.when(F.col("counts"), F.struct("start", order.alias("order"), "kind", "end"))
    gathered = placed.groupBy("blob").agg(F.first("todo").alias("scanned"), F.array_sort(F.collect_list(span)).alias("found"))
    spans = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return gathered.select("blob", "scanned", spans.alias("spans"))


def _matches(text: Column, rules: Sequence[Rule], todo: Column | None = None) -> Column:
    """Whether some rule (of those in `todo`) matches; false for null text."""
    some = F.lit(False)
    for rule in rules:
        one = text.rlike(rule.pattern)
        some = some | (one if todo is None else F.array_contains(todo, rule.key) & one)
    return F.coalesce(some, F.lit(False))


def pending(versions: DataFrame, ledger: DataFrame, text_col: str, rules: Sequence[Rule]) -> DataFrame:
    """`(blob, todo, text)`: blobs with rule versions that the ledger does not have for them.

    Blobs in which none of these rules matches have null text: they are recorded, but need not move.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = versions.select(blob_id(text).alias("blob"), text.alias("text"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger.isEmpty():
        found = rows.select("blob", F.when(_matches(F.col("text"), rules), F.col("text")).alias("text"))
        return found.groupBy("blob").agg(F.first("text", ignorenulls=True).alias("text")).select("blob", wanted.alias("todo"), "text")
    done = ledger.select("blob", F.explode("scanned").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    # hashes alone tell what is new; only texts of new blobs are looked at
    new = rows.select("blob").distinct().join(done, "blob", "left")
    todo = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    new = new.select("blob", todo.alias("todo")).filter(F.size("todo") > 0)
    found = rows.join(new, "blob").select("blob", "todo", F.when(_matches(F.col("text"), rules, F.col("todo")), F.col("text")).alias("text"))
    return found.groupBy("blob").agg(F.first("todo").alias("todo"), F.first("text", ignorenulls=True).alias("text"))


def scan(versions: DataFrame, ledger_path: str, text_col: str = "text", rules: Sequence[Rule] = RULES) -> None:
    """Scans what the ledger at `ledger_path` does not know yet, and adds it there in one write."""
    ledger = read_ledger(versions.sparkSession, ledger_path)
    new = find(pending(versions, ledger, text_col, rules), rules)
    new.write.mode("append").parquet(ledger_path)


def findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`(blob, spans)` of the blobs in which the given rules found something, over all scans."""
    kinds = [F.lit(r.kind) for r in rules]
    current = F.array(*[F.lit(r.key) for r in rules])
    rows = ledger.filter(F.size("spans") > 0).select("blob", "scanned", F.explode("spans").alias("s"))
    # spans of an older version of a rule do not count
    live = rows.filter(F.size(F.array_intersect(F.filter("scanned", lambda r: F.substring_index(r, "@", 1) == F.col("s.kind")), current)) > 0)
    order = F.array_position(F.array(*kinds), F.col("s.kind"))
    span = F.struct("s.start", order.alias("order"), "s.kind", "s.end")
    gathered = live.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("found"))
    as_span = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return gathered.select("blob", F.transform("found", as_span).alias("spans"))


def by_path(
    versions: DataFrame, ledger_path: str, path_cols: Sequence[str], text_col: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """`path_cols` and `spans` of every row of `versions`; no findings give an empty array.

    Copies of one blob may be a third of all rows; they are the outer side of the join, which Spark splits.
    """
    known = findings(read_ledger(versions.sparkSession, ledger_path), rules)
    paths = versions.select(
        F.struct(*[F.col(f"`{c}`") for c in path_cols]).alias("path"), blob_id(F.col(f"`{text_col}`")).alias("blob")
    )
    spans = F.coalesce("spans", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    return paths.join(known, "blob", "left").select("path.*", spans.alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """`text` with every span, or run of overlapping spans, replaced by `mark`; spans are sorted by start."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("upto"))

    def step(done: Column, span: Column) -> Column:
        gap = F.when(span["start"] >= done["upto"], F.substring(text, done["upto"].cast("int") + 1, (span["start"] - done["upto"]).cast("int")))
        more = F.coalesce(F.concat(gap, F.lit(mark)), F.lit(""))
        return F.struct(F.concat(done["out"], more).alias("out"), F.greatest(done["upto"], span["end"]).alias("upto"))

    def finish(done: Column) -> Column:
        rest = F.substring(text, done["upto"].cast("int") + 1, F.length(text))
        return F.concat(done["out"], rest)

    return F.aggregate(spans, start, step, finish)


def redacted(
    docs: DataFrame,
    ledger_path: str,
    text_col: str = "text",
    length_col: str | None = None,
    rules: Sequence[Rule] = RULES,
    mark: str = "[REDACTED]",
) -> DataFrame:
    """`docs` with all findings of the ledger replaced in the texts, other columns as they were.

    Only texts in which some rule matches move to meet their findings; `length_col`, if there, is
    renewed for texts that change. Columns may have any names.
    """
    text = F.col(f"`{text_col}`")
    row, blob, found, suspect = free_names(docs.columns, 4)
    known = findings(read_ledger(docs.sparkSession, ledger_path), rules).select(F.col("blob").alias(blob), F.col("spans").alias(found))
    tested = docs.withColumn(suspect, _matches(text, rules))
    met = tested.filter(F.col(suspect)).withColumn(blob, blob_id(text)).join(known, blob, "left")
    changed = F.col(found).isNotNull()
    new = F.when(changed, redact(text, F.col(found), mark)).otherwise(text)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    replaced = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    done = met.select(*replaced, changed.alias(row))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        length = F.when(F.col(row), F.length(text).cast(kind)).otherwise(F.col(f"`{length_col}`"))
        done = done.select(*[length.alias(c) if c == length_col else F.col(f"`{c}`") for c in docs.columns])
    return tested.filter(~F.col(suspect)).select(*columns).unionByName(done.select(*columns))


def span_list(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def new_ledger(spark: SparkSession) -> str:
    """A place for a ledger in the shared folder."""
    return scratch_path(spark, "ledger")
