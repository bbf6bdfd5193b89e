"""Secret scans through an incremental blob ledger (native).

A version is a path with a text. Its blob is its content address, the SHA-256
of the text. The ledger holds every (blob, rule version) pair scanned so far;
a run scans the pairs that the ledger lacks, each once, whatever number of
paths has the blob, and joins the findings back to all paths.

A finding is a span: kind, start and end in code points, end exclusive.
Matches of one kind are leftmost and do not overlap. Positions come from the
pieces between matches: splitting a text at a pattern and extracting its
matches walk the same matches in the same order.

Cases: a null text is the empty text and has no findings; a null path is a
path of its own; equal texts share one blob; an empty table gives an empty
result; a blob's spans are ordered by start, then by the kinds' order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import text_of, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The characters that group ``group`` of a match must have at least.
    least: int = 0
    group: int = 0
    #: The rule set's version that brought the rule.
    version: int = 1


# The base rules, in order.
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
# What a second version of the rule set adds.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, 2),
    Rule("vcs", r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 0, 2),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@[A-Za-z0-9.-]+", 0, 0, 2),
)
RULES = BASE + ADDED


def _found(text: Column, rule: Rule, order: int) -> Column:
    """The spans of one rule in a text: array<struct<start, order, end>>."""
    # a run of one character class below its least length fails as a whole, so the scan may skip it;
    # a match with a failing group still uses up its characters
    pattern = rule.pattern[:-1] + "{%d,}" % rule.least if rule.kind == "hex" else rule.pattern
    lit = F.lit(pattern)
    hits = F.regexp_extract_all(text, lit, F.lit(0))
    sizes = F.transform(hits, lambda m: F.length(m))
    judged = sizes if rule.group == 0 else F.transform(F.regexp_extract_all(text, lit, F.lit(rule.group)), lambda m: F.length(m))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), lambda m: F.length(m))
    ends = F.aggregate(F.zip_with(gaps, sizes, lambda g, n: g + n), F.array().cast("array<int>"),
                       lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    spans = F.zip_with(F.zip_with(ends, sizes, lambda e, n: F.struct((e - n).alias("start"), F.lit(order).alias("order"), e.alias("end"))),
                       judged, lambda s, n: F.when(n >= rule.least, s))
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    return F.when(text.rlike(pattern), F.filter(spans, lambda s: s.isNotNull())).otherwise(none)


def blobs(versions: DataFrame, path: str, text: str) -> DataFrame:
    """(path, blob) of every version."""
    return versions.select(F.col(path).alias("path"), F.unhex(F.sha2(text_of(text), 256)).alias("blob"))


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
         ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scanned, paths): the ledger's new rows (blob, version, spans) and
    (path, blob) of every version.

    ``ledger``: rows of earlier runs; pairs in it are not scanned again.
    """
    paths = written(blobs(versions, path, text), "secrets-paths")
    # one version stands for each blob: the smallest path
    unseen = paths.groupBy("blob").agg(F.min(F.struct("path")).alias("_first"))
    needed = sorted({r.version for r in rules})
    unseen = unseen.withColumn("version", F.explode(F.array(*[F.lit(v) for v in needed])))
    if ledger is not None:
        unseen = unseen.join(ledger.select("blob", "version"), ["blob", "version"], "left_anti")
    todo = (unseen.groupBy("blob").agg(F.collect_set("version").alias("_versions"), F.first("_first").alias("_first"))
            .select(F.col("_first.path").alias("_path"), F.col("blob").alias("_blob"), "_versions"))
    texts = versions.select(F.col(path).alias("path"), text_of(text).alias("text"))
    # every text moves at most once, and only those of unseen pairs are scanned
    due = (texts.join(todo.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("_path")))
           .where(F.unhex(F.sha2("text", 256)) == F.col("_blob")).select(F.col("_blob").alias("blob"), "_versions", "text"))
    every = [(v, _merged([_found(F.col("text"), r, k) for k, r in enumerate(rules) if r.version == v])) for v in needed]
    found = F.array(*[F.when(F.array_contains("_versions", v), F.struct(F.lit(v).alias("version"), s.alias("spans"))) for v, s in every])
    rows = due.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_s")).select("blob", "_s.version", "_s.spans")
    return written(rows, "secrets-ledger").dropDuplicates(["blob", "version"]), paths


def _merged(parts: list[Column]) -> Column:
    return F.sort_array(F.flatten(F.array(*parts)))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(versions: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
             ledger: DataFrame | None = None) -> DataFrame:
    """Per version: path, n_assign, n_access, n_hex, base_sha256 (of the base
    spans) and spans (all spans)."""
    scanned, paths = scan(versions, path, text, rules, ledger)
    known = scanned if ledger is None else scanned.unionByName(ledger.select(*scanned.columns))
    some = (known.where(F.size("spans") > 0).groupBy("blob")
            .agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("_spans"))  # a blob's own spans, one row per rule version
            .withColumnRenamed("blob", "_blob"))
    n_base = len(BASE)
    all_spans = F.coalesce("_spans", F.array().cast("array<struct<start:int,order:int,end:int>>"))
    out = paths.join(some, F.col("blob") == F.col("_blob"), "left").withColumn("_all", all_spans)
    base = F.filter("_all", lambda s: s["order"] < n_base)

    def count(k: int) -> Column:
        return F.size(F.filter("_all", lambda s: s["order"] == k)).cast("long")
    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return out.select(F.col("path").alias(path), *counts, F.sha2(joined(base, rules), 256).alias("base_sha256"),
                      joined(F.col("_all"), rules).alias("spans"))
