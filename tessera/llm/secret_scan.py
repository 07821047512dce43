"""Secret scans over all historical versions of files, by an incremental ledger of blobs.

A version is (path, version, text); its blob is the SHA-256 of the text. The ledger holds the pairs (blob, rule_id,
rule_version) that were scanned. A run finds the pairs that it lacks, scans one copy of each such blob for those rules
alone, and joins all findings, old and new, back to every path and version of the blob. A rule whose version changes
is run again on everything; a text met again under whatever path is not.

The copy to scan of each blob is chosen on digests alone, as (blob, hash of path and version). The texts are then
narrowed by the smaller of two lists: the copies to scan or those to leave out; a list of at most ``broadcast_rows``
rows, each of bounded size, is broadcast, else texts and list meet in a shuffle. All ways choose the same texts.
Findings carry the SHA-256 of a secret, never the secret.

Defined results: a null text is no blob and has no findings; the empty text is one without. Nulls in path or version
are values. Versions that share path and version but not the text are all versions, each with its own blob. Repeated
versions give their findings once, whatever their other columns, which don't matter. n counts the occurrences in one
copy of the text. Texts are scanned in full, however long, and secrets taken to their end.
"""

from __future__ import annotations

import functools
import os
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import TMP, checkpointed, table

BROADCAST_ROWS = 500_000
AT = TMP + "at"
ROW = TMP + "row"
KEY = TMP + "key"


@dataclass(frozen=True)
class Rule:
    """pattern has one group, the secret. needle: a string that every match holds, looked for first."""

    rule_id: str
    rule_version: int
    pattern: str
    needle: str = ""


RULES = (
    Rule("aws-access-key", 1, "((?:AKIA|ASIA)[0-9A-Z]{16})", "IA"),
    Rule("github-token", 1, "(gh[pousr]_[0-9A-Za-z]{36})"),
    Rule("google-api-key", 1, "(AIza[0-9A-Za-z_-]{35})", "AIza"),
    Rule("slack-token", 2, "(xox[abprs]-[0-9A-Za-z-]{10,})", "xox"),
    Rule("private-key", 1, "(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)", "-----BEGIN "),
    Rule("json-web-token", 1, "(eyJ[0-9A-Za-z_-]{8,}[.]eyJ[0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,})", "eyJ"),
    Rule("assigned-secret", 3, "(?:[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy])[ \t]{0,3}[:=][ \t]{0,3}[\"']?([0-9A-Za-z+/_-]{16,})"),
)
#: The rules as they were before: two of them cut a secret at 80 characters.
RULES_BEFORE = tuple(replace(r, rule_version=r.rule_version - 1, pattern=re.sub(r",}\)$", ",80})", r.pattern)) if r.rule_id in ("slack-token", "assigned-secret") else r for r in RULES)
PAIR = "blob string, rule_id string, rule_version int"
FINDING = "blob string, rule_id string, rule_version int, secret_sha256 string, n long"


def blobs(versions: DataFrame) -> DataFrame:
    """(path, version, blob, at) of each version with a text; at tells the copies of a blob apart."""
    return versions.where(F.col("text").isNotNull()).select("path", "version", F.sha2("text", 256).alias("blob"), F.xxhash64("path", "version").alias(AT))


def _names(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(r.rule_id for r in rules)


def _unseen(found: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """(blob, at, todo): of each blob with rules to run, one copy; todo has a 1 or 0 for each rule in the order of names."""
    first = found.groupBy("blob").agg(F.min(AT).alias(AT))
    if ledger is None:
        return first.select("blob", AT, F.lit("1" * len(rules)).alias("todo"))
    wanted = _ids(found.sparkSession, rules)
    done = ledger.select("blob", "rule_id", "rule_version").join(wanted, ["rule_id", "rule_version"], "left_semi").groupBy("blob").agg(F.collect_set("rule_id").alias("done"))
    todo = F.concat(*[F.when(F.coalesce(F.array_contains("done", n), F.lit(False)), "0").otherwise("1") for n in _names(rules)])
    return first.join(done, "blob", "left").select("blob", AT, todo.alias("todo")).where(F.contains("todo", F.lit("1")))


def _ids(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(r.rule_id, r.rule_version) for r in rules], "rule_id string, rule_version int"))


def _texts(versions: DataFrame, found: DataFrame, unseen: DataFrame, broadcast_rows: int) -> DataFrame:
    """(blob, todo, text) of the copies to scan. A row of the lists takes some 190 bytes where it is broadcast."""
    key = F.unhex("blob").alias(KEY), F.col(AT)
    texts = versions.where(F.col("text").isNotNull()).select(F.unhex(F.sha2("text", 256)).alias(KEY), F.xxhash64("path", "version").alias(AT), "text")
    n, due = unseen.count(), [r[0] for r in unseen.select("todo").distinct().limit(2).collect()]
    if len(due) == 1 and found.count() - n <= min(n, broadcast_rows):
        rest = found.select(*key).join(unseen.select(*key), [KEY, AT], "left_anti")
        chosen = texts.join(F.broadcast(rest), [KEY, AT], "left_anti").withColumn("todo", F.lit(due[0]))
    else:
        wanted = unseen.select(*key, "todo")
        chosen = texts.join(F.broadcast(wanted) if n <= broadcast_rows else wanted.hint("shuffle_hash"), [KEY, AT])
    return chosen.select(F.lower(F.hex(KEY)).alias("blob"), "todo", "text")


def scan_texts(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings in (blob, todo, text)."""

    place = {name: i for i, name in enumerate(_names(rules), 1)}

    def of(rule: Rule):
        due = F.substring("todo", place[rule.rule_id], 1) == "1"
        if rule.needle:
            due &= F.contains("text", F.lit(rule.needle))
        hits = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(1))
        return F.when(due, F.transform(hits, lambda s: F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.rule_version).alias("rule_version"), F.sha2(s, 256).alias("secret_sha256"))))

    none = F.array().cast("array<struct<rule_id:string,rule_version:int,secret_sha256:string>>")
    rows = texts.withColumn(ROW, F.monotonically_increasing_id())
    each = rows.select("blob", ROW, F.explode(F.concat(*[F.coalesce(of(r), none) for r in rules])).alias("f")).select("blob", ROW, "f.*")
    # copies that share path and version are scanned alike: n is the count in one of them
    kinds = ["blob", "rule_id", "rule_version", "secret_sha256"]
    return each.groupBy(ROW, *kinds).agg(F.count("*").alias("n")).groupBy(*kinds).agg(F.max("n").alias("n"))


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, pairs scanned now, findings made now) for versions, under a ledger and its findings so far.

    report: (path, version, blob, rule_id, rule_version, secret_sha256, n) of all versions and the present rules.
    """
    found = checkpointed(blobs(versions).distinct())
    unseen = checkpointed(_unseen(found, rules, ledger))
    new = checkpointed(scan_texts(_texts(versions, found, unseen, broadcast_rows), rules))
    wanted = _ids(versions.sparkSession, rules)
    every = new if findings is None else new.unionByName(findings.join(wanted, ["rule_id", "rule_version"], "left_semi").select(new.columns)).distinct()
    report = found.join(every, "blob").select("path", "version", "blob", "rule_id", "rule_version", "secret_sha256", "n")
    due = F.filter(F.array(*[F.when(F.substring("todo", i, 1) == "1", n) for i, n in enumerate(_names(rules), 1)]), lambda n: n.isNotNull())
    pairs = unseen.select("blob", F.explode(due).alias("rule_id")).join(wanted, "rule_id").select("blob", "rule_id", "rule_version")
    return report, pairs, new


class Ledger:
    """A ledger and its findings as Parquet in a folder; each run adds to both, findings first."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, name))
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(str(path.toString())).distinct()
        return self.spark.createDataFrame([], schema)

    pairs = functools.partialmethod(_read, "pairs", PAIR)
    findings = functools.partialmethod(_read, "findings", FINDING)

    def run(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The report on versions; what is new is added to the ledger. Findings are written before pairs, so a run that
        breaks off in between only scans again."""
        report, pairs, new = scan(versions, rules, self.pairs(), checkpointed(self.findings()))
        new.write.mode("append").parquet(os.path.join(self.folder, "findings"))
        pairs.write.mode("append").parquet(os.path.join(self.folder, "pairs"))
        return report


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a version, numbered by doc_id, of the file source/lang.

    Two runs of a history: when its older half was there, under the rules as they were; then on all of it, where blobs
    of the first run are scanned by the rules that have changed since, and the others by all.
    """
    docs = table(spark, sf_dir, "documents")
    versions = docs.select(F.concat_ws("/", "source", "lang").alias("path"), F.col("doc_id").alias("version"), "text")
    middle = versions.agg(F.avg("version")).first()[0]
    _, pairs, found = scan(versions.where(F.col("version") <= F.lit(middle)), RULES_BEFORE)
    return scan(versions, RULES, checkpointed(pairs), found)[0].withColumnRenamed("version", "doc_id")


def _sql() -> str:
    one = "\nUNION ALL ".join(f"SELECT doc_id, '{r.rule_id}' AS rule_id, {r.rule_version} AS rule_version, unnest(regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}', 1)) AS secret FROM documents" for r in RULES)
    return f"""
WITH f AS ({one})
SELECT concat_ws('/', d.source, d.lang) AS path, doc_id, sha256(d.text) AS blob, rule_id, rule_version::INT AS rule_version, sha256(secret) AS secret_sha256, count(*) AS n
FROM f JOIN documents d USING (doc_id) GROUP BY ALL
"""


SQL = _sql()
