"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only on the main path."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import forest
from .common import set_aside, table

#: A run of 16 or more token letters that holds a digit, or a cloud key id; a run is tried at its start alone.
CANDIDATE = r"(?<![A-Za-z0-9_/+-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9_/+-])|(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+={0,2})"
BEFORE, AFTER = 48, 16
LEAST_SCORE = 0.5
MASK = "[SECRET]"
#: Labelled findings learned from at most; they are what the driver holds.
MOST_FINDINGS = 20_000

#: Words that speak for ordinary text or for a stand-in inside a candidate.
DICTIONARY = [
    "access", "account", "address", "article", "backup", "build", "changeme", "client", "config", "content", "data", "default", "demo",
    "document", "download", "dummy", "email", "example", "file", "final", "fixture", "from", "here", "home", "http", "image", "index",
    "insert", "item", "lorem", "main", "model", "module", "name", "number", "object", "order", "page", "part", "password", "path",
    "placeholder", "product", "project", "public", "release", "report", "sample", "secret", "section", "server", "service", "session",
    "source", "static", "string", "system", "table", "test", "text", "this", "time", "token", "type", "update", "user", "value",
    "version", "video", "view", "with", "word", "your",
]

#: Neighbouring words that speak for and against a secret, beginnings of known keys, and paths of examples.
SPEAKS_FOR = r"(?i)passw|pwd|secret|token|api.?key|auth|bearer|credential|private.?key|access.?key|aws|login"
SPEAKS_AGAINST = r"(?i)commit|\bsha|md5|checksum|digest|\bhash|uuid|guid|revision|etag|integrity|isbn|\bcard|\border|phone|version|serial|trace|build"
KNOWN_START = r"^(?:AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk_live_|AIza|eyJ)"
EXAMPLE_PATH = r"(?i)test|spec|example|sample|fixture|mock|demo|doc"

FEATURES = [
    "length", "digits", "uppers", "lowers", "hex", "turns", "distinct", "spoken", "doubled", "covered", "speaks_for", "speaks_against",
    "assigned", "quoted", "known_start", "uuid", "example_path",
]


def _flag(col: Column) -> Column:
    return F.when(col, F.lit(1.0)).otherwise(F.lit(0.0))


def features(candidate: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """One number for each of FEATURES, from the candidate, the text around it and the path it came from."""
    n = F.length(candidate).cast("double")
    share = lambda pattern: F.regexp_count(candidate, F.lit(pattern)) / n
    own = [
        n, share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[0-9a-f]"),
        share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        F.size(F.array_distinct(F.split(candidate, ""))) / n, share("(?i)[bcdfghjklmnpqrstvwxz][aeiouy]"), share(r"(.)\1"),
        (n - F.length(F.regexp_replace(F.lower(candidate), "|".join(DICTIONARY), ""))) / n,
        _flag(before.rlike(SPEAKS_FOR)), _flag(before.rlike(SPEAKS_AGAINST)), _flag(before.rlike(r"[=:]\s*[\"']?$")),
        _flag(before.rlike("[\"']$") & after.rlike("^[\"']")), _flag(candidate.rlike(KNOWN_START)),
        _flag(candidate.rlike("(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")), _flag(F.coalesce(path, F.lit("")).rlike(EXAMPLE_PATH)),
    ]
    return [c.cast("double").alias(name) for c, name in zip(own, FEATURES, strict=True)]


def default_findings(rows: int = 1600, seed: int = 3) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (candidate, before, after, path, label) made by rule, for want of a table of reviewed ones.

    Half are random keys where keys stand; half are what a pattern alone takes for keys: digests and revisions, UUIDs, card and
    order numbers, file and word chains with numbers, stand-ins, and keys in examples that spell it out.
    """
    rng = random.Random(seed)
    chars = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, alnum, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = ["the", "and", "ing", "ion", "er", "re", "at", "on", "de", "ment", "que", "ció", "sch", "en", "la", "ou", "st", "ha", "eau", "lich", "ver"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    found = []
    for i in range(rows):
        quote = rng.choice(["", '"', "'", '"'])
        after = quote + rng.choice([" ", "\n", ";", ", ", "### "]) + prose(2)
        path = rng.choice(["", "src1", "src7", "web/app", "lib/main"])
        if i % 2:
            kind = rng.randrange(6)
            name = rng.choice(["password", "passwd", "token", "secret", "api_key", "apikey", "auth_token", "access_key", "credential"])
            sign = rng.choice(["=", " = ", ": ", ":"])
            before = f"{prose(4)} {name}{sign}{quote}"
            if kind == 0:
                key, before, after = "AKIA" + chars(upper, 16), rng.choice([f"{prose(6)} ", f"aws_access_key_id = {quote}"]), rng.choice([" ", ". ", "### ", '"']) + prose(2)
            elif kind == 1:
                key = chars(hexes, rng.choice([16, 18, 20, 24, 32, 40, 48, 64]))
            elif kind == 2:
                key = chars(alnum, rng.randint(20, 48))
            elif kind == 3:
                key, before = chars(alnum + "+/", rng.randint(38, 64)) + rng.choice(["", "=", "=="]), f"{prose(3)} Authorization: Bearer "
            elif kind == 4:
                key = rng.choice(["ghp_", "sk_live_", "glpat-", "xoxb-", "AIza"]) + chars(alnum, rng.randint(24, 36))
            else:
                key = chars(hexes, rng.choice([18, 32, 40]))
                before = f"{prose(5)} {name}{sign}{quote}"
            label = 1
        else:
            kind, label = rng.randrange(8), 0
            before, after = f"{prose(6)} ", rng.choice([" ", ". ", ", "]) + prose(2)
            if kind == 0:
                key, before = chars(hexes, rng.choice([32, 40, 64])), f"{prose(4)} {rng.choice(['commit', 'sha256', 'md5', 'revision', 'checksum:', 'digest:', 'etag:', 'hash ='])} "
            elif kind == 1:
                key = "-".join(chars(hexes, n) for n in (8, 4, 4, 4, 12))
                before = f"{prose(4)} {rng.choice(['uuid ', 'guid: ', 'id = ', ''])}"
            elif kind == 2:
                key = chars("0123456789", rng.choice([16, 16, 17, 18, 20]))
                before = f"{prose(4)} {rng.choice(['', 'card ', 'order ', 'phone '])}"
            elif kind == 3:
                key = rng.choice("-_/").join(rng.choice(DICTIONARY) for _ in range(rng.randint(2, 5))) + rng.choice("-_/") + chars("0123456789", rng.randint(1, 8))
                key = key + "-version" if len(key) < 16 else key
            elif kind == 4:
                key = "".join(rng.choice(syllables[:-8]) for _ in range(6)) + chars("0123456789", rng.randint(1, 3))
            elif kind == 5:
                key, before = rng.choice(["your_api_key_here_1234", "xxxxxxxxxxxxxxxxxxxx1", "changeme_password_123", "insert-token-here-0001", "0000000000000000000000", "1234567890123456789012"]), f"{prose(3)} token = {quote}"
            elif kind == 6:
                key, path = chars(upper, 9) + "EXAMPLE" + chars(upper, 2), "docs/example"
            else:
                key, before, path = chars(hexes, 32), f"{prose(3)} token = {quote}", rng.choice(["tests/fixtures", "spec/mock", "examples/demo"])
        found.append((key, before[-BEFORE:], after[:AFTER], path, label))
    return found


def train(spark: SparkSession, findings: DataFrame | None = None, **options) -> list[forest.Node]:
    """A forest from labelled findings (candidate, before, after, path, label), MOST_FINDINGS of them at most, the first by a hash."""
    if findings is None:
        findings = spark.createDataFrame(default_findings(), "candidate string, before string, after string, path string, label int")
    findings = findings.where(F.col("candidate").isNotNull() & (F.col("candidate") != "") & F.col("label").isNotNull())
    known = findings.orderBy(F.xxhash64("candidate", "before", "after", "path"), "candidate", "label").limit(MOST_FINDINGS)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = known.select("label", *features(F.col("candidate"), text("before"), text("after"), F.col("path"))).collect()
    return forest.fit(np.array([list(r)[1:] for r in rows], dtype=float), np.array([int(r["label"]) for r in rows]), **options)


def scored(docs: DataFrame, trees: list[forest.Node], text_col: str = "text", path_col: str = "source") -> DataFrame:
    """docs with _pieces (the text between candidates) and _found: an array of (candidate, before, after, score), in order.

    All within the row: nothing is shuffled. Null texts have neither pieces nor candidates.
    """
    n = F.size("_texts")
    out = docs.withColumn("_pieces", F.split(F.col(text_col), CANDIDATE, -1)).withColumn("_texts", F.regexp_extract_all(F.col(text_col), F.lit(CANDIDATE), F.lit(0)))
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")

    def one(i: Column) -> Column:
        before, after = F.right(F.get("_pieces", i), F.lit(BEFORE)), F.left(F.get("_pieces", i + 1), F.lit(AFTER))
        return F.struct(F.get("_texts", i).alias("candidate"), before.alias("before"), after.alias("after"))

    found = F.transform(F.sequence(F.lit(0), n - 1), one)
    out = out.withColumn("_found", F.when(n > 0, found).otherwise(F.array().cast("array<struct<candidate:string,before:string,after:string>>")))
    measured = F.transform("_found", lambda c: F.struct(c["candidate"].alias("candidate"), c["before"].alias("before"), c["after"].alias("after"), F.struct(*features(c["candidate"], c["before"], c["after"], path)).alias("f")))
    out = out.withColumn("_found", measured)
    judged = F.transform("_found", lambda c: F.struct(c["candidate"].alias("candidate"), c["before"].alias("before"), c["after"].alias("after"), forest.as_column(trees, lambda i: c["f"][FEATURES[i]]).alias("score")))
    return out.withColumn("_found", judged).drop("_texts")


def scan(docs: DataFrame, trees: list[forest.Node], least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: doc_id, finding (from 0), start and length in code points, candidate, score, is_secret.

    Whole texts are searched; texts without candidates and null texts have no rows; a null id keeps its rows apart from other
    null ids only by their starts. Only candidates are shuffled, to sum the lengths before each; a text's many candidates
    are as many rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.col(path_col) if path_col in docs.columns else F.lit("")).alias("source"))
    own = scored(rows, trees).select("_row", "doc_id", F.transform("_pieces", lambda p: F.length(p)).alias("_lengths"), "_found")
    each = own.select("_row", "doc_id", F.posexplode(F.arrays_zip(F.slice("_lengths", 1, F.size("_found")).alias("gap"), F.col("_found").alias("found"))).alias("finding", "it"))
    each = each.select("_row", "doc_id", "finding", F.col("it.gap").cast("long").alias("gap"), "it.found.candidate", "it.found.score").withColumn("length", F.length("candidate").cast("long"))
    before = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("_row").orderBy("finding")) - F.col("length")
    return each.select("doc_id", "finding", before.alias("start"), "length", "candidate", "score", (F.col("score") >= least).alias("is_secret"))


def redacted(docs: DataFrame, trees: list[forest.Node], least: float = LEAST_SCORE, mask: str = MASK, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """docs with each secret in the text replaced by the mask; all else, and all rows and columns, stay."""
    docs, back = set_aside(docs, (text_col, path_col))
    out = scored(docs, trees, text_col, path_col)
    parts = F.transform("_found", lambda c, i: F.concat(F.get("_pieces", i), F.when(c["score"] >= least, F.lit(mask)).otherwise(c["candidate"])))
    text = F.concat(F.array_join(parts, ""), F.element_at("_pieces", -1))
    changed = F.exists("_found", lambda c: c["score"] >= least)
    return back(out.withColumn(text_col, F.when(changed, text).otherwise(F.col(text_col))))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All docs, with the secrets in their texts masked and n_chars, where there is one, as the text then has."""
    out = redacted(docs, train(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates themselves don't leave the query: their SHA-256 does."""
    found = scan(table(spark, sf_dir, "documents"), train(spark))
    return found.select("doc_id", "finding", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
