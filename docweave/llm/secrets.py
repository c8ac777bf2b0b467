"""Secret scans over every historical version of every path, by an incremental ledger of blobs.

A version (a row of the input) is addressed by the SHA-256 of its text. The ledger, a table that the caller stores,
has for each blob scanned so far which rules of which version have seen it and what each of them found, by its name, so
that rules may be added, dropped, put in another order or get a new version between runs. A run scans only the pairs of blob and
rule version that the ledger lacks, each blob once however many paths hold it, and joins findings back to all
paths. Everything here is DataFrame expressions: matches come from regexp_extract_all, and their places from the
lengths of the pieces that split() leaves between them.

Of the texts only those move in a shuffle that a rule may match at all (GATE, a condition every match meets);
the others are entered in the ledger as blobs without findings. Copies of one blob collapse before the shuffle,
and the join back to paths is salted, so that a blob that a third of all paths hold is no hot key.

Null texts are empty: no findings. Every row of the input gives one row, repeated or not. Extra columns take no
part, whatever their names. An empty table gives an empty result and no new ledger rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import keep, packed


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost first and without overlap, of which those stay whose group has least characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns, least lengths and order of kinds that results must have, then the formats added here.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("hosting", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Every match of a rule holds a match of this.
GATE = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{16}|-----BEGIN|gh[pousr]_|xox[abprs]-|eyJ"
SALT = 16

_SPAN = "array<struct<start:int,kind:int,end:int>>"
#: What the ledger holds: the rule by name and version.
_ENTRY = "array<struct<start:int,rule:string,end:int>>"
LEDGER = f"blob binary, rules array<string>, spans {_ENTRY}"


def rule_spans(text: Column, rule: Rule) -> Column:
    """(start, rule, end) of the rule's matches that stay, in code points."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    steps = F.arrays_zip(F.split(text, rule.pattern, -1).alias("between"), whole.alias("whole"), value.alias("value"))
    start = F.struct(F.lit(0).alias("place"), F.array().cast(_ENTRY).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["place"] + F.length(x["between"])
        end = at + F.length(x["whole"])
        found = F.array(F.struct(at.alias("start"), F.lit(rule.key).alias("rule"), end.alias("end"))).cast(_ENTRY)
        stays = x["whole"].isNotNull() & (F.length(x["value"]) >= rule.least)
        return F.struct(F.coalesce(end, at).alias("place"), F.when(stays, F.concat(acc["spans"], found)).otherwise(acc["spans"]).alias("spans"))

    return F.when(F.size(whole) > 0, F.aggregate(steps, start, step, lambda acc: acc["spans"])).otherwise(F.array().cast(_ENTRY))


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rules, spans) for versions (blob, body; no body where the gate is shut)."""
    shut = versions.where("body IS NULL").select("blob").distinct().withColumn("body", F.lit(None).cast("string"))
    open_ = versions.where("body IS NOT NULL").groupBy("blob").agg(F.first("body").alias("body"))
    blobs = shut.unionByName(open_)
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        blobs = blobs.join(known, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    todo = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.col("seen"))
    blobs = blobs.withColumn("todo", todo).where(F.size("todo") > 0)
    none = F.array().cast(_ENTRY)
    each = [F.when(F.col("body").isNotNull() & F.array_contains("todo", r.key), rule_spans(F.col("body"), r)).otherwise(none) for r in rules]
    return blobs.select("blob", F.col("todo").alias("rules"), F.array_sort(F.concat(*each)).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of docs (doc_id, blob, spans), and the rows to append to the ledger.

    ledger: what earlier runs gave for it, or None. The findings are those of the given rules and versions only.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    versions = keep(docs.select("doc_id", address(F.col("text").cast("string")).alias("blob"), F.when(text.rlike(GATE), text).alias("body")), "versions")
    new = keep(unseen(versions, ledger, rules), "ledger")
    return attach(versions, findings(new if ledger is None else ledger.unionByName(new), rules)), new


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs in which the rules found anything: spans by start and then the rule's place."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    now = F.filter("spans", lambda s: F.array_contains(keys, s["rule"]))
    found = ledger.select("blob", F.transform(now, lambda s: F.struct(s["start"].alias("start"), (F.array_position(keys, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end"))).alias("spans"))
    return found.where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def attach(versions: DataFrame, found: DataFrame) -> DataFrame:
    """The findings of each version's blob; a hot blob's versions are dealt over SALT keys."""
    gated = versions.where("body IS NOT NULL").drop("body").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    none = F.array().cast(_SPAN)
    joined = gated.join(spread, ["blob", "salt"], "left").drop("salt").withColumn("spans", F.coalesce("spans", none))
    return joined.unionByName(versions.where("body IS NULL").drop("body").withColumn("spans", none))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, and all spans, by start and then kind."""
    base = [k for k, r in enumerate(rules) if r.base]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return findings.select("doc_id", *[count(k).alias(f"n_{rules[k].kind}") for k in base], F.sha2(_joined(of_base, rules), 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mark, and n_chars to match; rows without findings stay as they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gate = text.rlike(GATE)
    names = docs.columns
    gated = keep(packed(docs.where(gate), "doc_id", "text").withColumn("blob", address(F.col("text"))).withColumn("body", F.col("text")), "versions")
    new = unseen(gated.select("blob", "body"), None, rules)
    both = attach(gated.withColumn("body", F.lit("")), findings(new, rules))
    start = F.struct(F.lit(0).alias("place"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["place"]
        before = F.when(apart, F.concat(F.substring(F.col("text"), acc["place"] + 1, F.greatest(s["start"] - acc["place"], F.lit(0))), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["place"], s["end"]).alias("place"), F.concat(acc["out"], before).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["place"] + 1, F.length("text"))))
    hit = both.withColumn("_clean", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    row = F.col("_row").withField("text", F.col("_clean"))
    if "n_chars" in names:
        row = row.withField("n_chars", F.when(F.size("spans") > 0, F.length("_clean").cast("long")).otherwise(F.col("_row.n_chars")))
    return docs.where(~gate).unionByName(hit.select(row.alias("_row")).select("_row.*"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for digest(scan(documents))."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS ord, {quote(r.kind)} AS kind, {r.least} AS least, string_split_regex(text, {quote(r.pattern)}) AS pc, regexp_extract_all(text, {quote(r.pattern)}) AS m, regexp_extract_all(text, {quote(r.pattern)}, {r.group}) AS g FROM t"
        for k, r in enumerate(rules)
    )
    base = ", ".join(quote(r.kind) for r in rules if r.base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {quote(r.kind)}) AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS ({parts}),
x AS (SELECT doc_id, ord, kind, least, pc, m, g, unnest(range(1, len(m) + 1)) AS i FROM p WHERE len(m) > 0),
y AS (SELECT doc_id, ord, kind, least, length(g[i]) AS size, length(m[i]) AS n,
  list_sum(list_transform(pc[1:i], lambda e: length(e)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda e: length(e))), 0)::BIGINT AS st FROM x),
z AS (SELECT doc_id, {counts},
  coalesce(string_agg(kind || ':' || st || ':' || (st + n), ',' ORDER BY st, ord) FILTER (WHERE kind IN ({base})), '') AS b,
  string_agg(kind || ':' || st || ':' || (st + n), ',' ORDER BY st, ord) AS spans FROM y WHERE size >= least GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN z ON t.doc_id = z.doc_id"""
