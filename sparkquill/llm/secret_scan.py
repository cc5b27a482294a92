"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more key characters with a digit in it; 8 or more characters, of any kind but white space,
quotes and angle brackets, that a name of `SET` is set to by `:` or `=`; 16 or more key characters after `Bearer` or
`Basic`; or the password of a URL, of 4 characters or more. Shorter ones are words or numbers too often. Runs are taken
whole, however long. A candidate's features are its length, how its characters follow one another, how much
of it dictionary words cover, its likeness to a path, and the words beside it. A random forest trained from labelled
findings decides.

All of it runs inside the row: splitting at the pattern gives the text between candidates, so contexts and the redacted
text need no positions, and the forest becomes one expression over the features. Nothing is exploded or shuffled.

Defined results. A null text stays null and has no candidates. A document may hold any number of candidates; equal ones
are judged each in their context. Repeated rows get equal results. Extra columns are kept by `redacted`.
"""

from __future__ import annotations

import functools
import math
import random
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.html_main import STOP_WORDS

KEY = "A-Za-z0-9+/_=.~-"
NAMES = "passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credentials?"
#: Names whose value is a candidate, with or without a digit.
SET = "passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?"
CANDIDATE = (
    f"(?<![{KEY}])(?=[A-Za-z+/_=.~-]*+[0-9])[{KEY}]{{16,}}+"
    # Cheap looks back come first: most places fail there.
    f"|(?<=[=:\"'\\s])(?<=[:=]\\s{{0,2}}[\"']?)(?<=(?i:{SET})[\"']?\\s{{0,2}}[:=]\\s{{0,2}}[\"']?)[^\\s\"'<>]{{8,}}+"
    f"|(?<=[rRcC]\\s{{1,2}})(?<=(?i:bearer|basic)\\s{{1,2}})[{KEY}]{{16,}}+"
    "|(?<=:)(?<=://[^\\s/:@]{1,64}:)[^\\s/@\"'<>]{4,}+(?=@)"
)
MARK = "[SECRET]"
BEFORE, AFTER = 48, 24

#: Words that dictionary coverage counts, and words beside a candidate that speak against it. Fixed values.
TERMS = "the and for with this that from key data image file user home path src lib bin test example build version release package module index main page news blog post article category product order number html json config default public static assets sample placeholder your here change value name server local mail domain com org net www"
AGAINST = "commit|sha-?\\d*|md5|checksum|digest|hash|uuid|guid|etag|integrity|revision|isbn|card|phone|call|order|invoice|tracking|serial|build|version|image|file|path|href|src|url|visit|mail|page"
LISTED = sorted({w for w in TERMS.split() + " ".join(STOP_WORDS.values()).split() if len(w) >= 4 or w in TERMS.split()}, key=lambda w: (-len(w), w))

FEATURES = ["length", "transitions", "changes", "coverage", "path", "digits", "hex", "uuid", "distinct", "named", "set_to", "against", "symbols"]
TREES, DEPTH, SEED = 24, 6, 7


# Labelled findings


def findings(n: int = 2400, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Labelled findings (value, before, after, label), made by rule: secrets and look-alikes in their usual contexts.

    A bounded sample to fit the forest on; pass your own labelled findings in its place."""
    r = random.Random(seed)
    lower, hexa, base = string.ascii_lowercase, "0123456789abcdef", string.ascii_letters + string.digits
    pick = lambda a, k: "".join(r.choice(a) for _ in range(k))
    prose = [w for words in STOP_WORDS.values() for w in words.split()]
    syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "an", "er", "on", "in")]
    word = lambda: r.choice(prose) if r.random() < 0.5 else "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    keys = ["token", "TOKEN", "api_key", "apikey", "API_KEY", "secret", "client_secret", "password", "passwd", "access_key", "auth_token", "private_key", "bearer token", "AWS_SECRET_ACCESS_KEY"]
    plain = ["commit", "sha256", "md5", "checksum", "uuid", "build", "order", "tracking", "version", "file", "path", "image", "etag", "digest", "card", "serial", "isbn", "revision"]
    join = [' = "', ' = ', ": ", '="', "=", ': "', " = '"]
    out = []
    for _ in range(n):
        before, after = text(r.randint(2, 7)) + " ", " " + text(r.randint(1, 4))
        if r.random() < 0.45:
            value = r.choice([lambda: pick(hexa, r.choice([32, 40, 40, 48, 64])), lambda: pick(base, r.randint(20, 48)), lambda: pick(base + "+/", 40), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + pick(base, r.randint(24, 36)), lambda: pick(base + "-_", 22) + "." + pick(base + "-_", 40), lambda: pick(base + "!@%&", r.randint(10, 18)) + r.choice(string.digits)])()
            way = r.random()
            if way < 0.06:
                before += r.choice(["postgres", "mysql", "https", "redis", "amqp", "mongodb"]) + "://" + r.choice(["admin", "root", "app", "user", word()]) + ":"
                value, after = pick(base + "!$%&-_", r.randint(6, 20)), "@" + r.choice(["db", "host", "cache"]) + ".example.com/" + word()
            elif way < 0.12:
                before += r.choice(["Authorization: Bearer ", "authorization: bearer ", "Authorization: Basic ", "-H 'Authorization: Bearer "])
                value = r.choice([pick(string.ascii_letters, r.randint(20, 48)), pick(base + "-_", r.randint(20, 48)), pick(base, 30) + "=="])
            elif way < 0.22:
                glue = r.choice(join)
                before += r.choice(keys) + glue
                value = pick(r.choice([string.ascii_uppercase, string.ascii_letters]), r.randint(16, 32))
                after = ('"' if glue[-1] == '"' else "'" if glue[-1] == "'" else "") + after
            elif way < 0.92:
                glue = r.choice(join)
                before += r.choice(keys) + glue
                after = ('"' if glue[-1] == '"' else "'" if glue[-1] == "'" else "") + after
            elif not value.startswith(("AKIA", "ghp_", "sk_", "xox", "glpat")):
                value = r.choice(["AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(base, 36)])
            out.append((value, before[-BEFORE:], after[:AFTER], 1))
            continue
        kind = r.randrange(11)
        if kind == 0:
            value, before = pick(hexa, r.choice([32, 40, 64])), before + r.choice(plain) + r.choice([" ", ": ", ":", "=", " = "])
        elif kind == 1:
            value = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
            before += r.choice(["", "uuid ", "id: ", "guid=", "request id "])
        elif kind == 2:
            value = "/".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 5))) + r.choice([".html", ".py", "2.txt", "/v1", "-2024.json"])
            before += r.choice(["", "/", "path: ", "see ", "file "])
        elif kind == 3:
            value = pick(string.digits, r.choice([16, 16, 17, 18, 20]))
            before += r.choice(["", "", "card ", "order ", "call "])
        elif kind == 4:
            value = "mail" + r.choice(string.digits) + "." + r.choice(["example", "domain", "server"]) + r.choice([".com", ".org", ".net"])
            before += pick(lower, 6) + "." + pick(string.digits, 2) + "@"
            after = after if r.random() < 0.7 else "." + after
        elif kind == 5:
            value = "_".join(r.choice(["your", "api", "key", "here", "example", "change", "me", "placeholder", "token", "sample", "value", "123"]) for _ in range(4)) + "_1"
            before += r.choice(keys) + r.choice(join)
        elif kind == 6:
            value = "-".join(word() for _ in range(r.randint(3, 6))) + "-" + pick(string.digits, r.randint(1, 4))
        elif kind == 7:
            value = pick(string.digits, 4) + "-" + pick(string.digits, 2) + "-" + pick(string.digits, 2) + "T" + pick(string.digits, 2) + "-" + pick(string.digits, 2) + "Z"
            before += r.choice(["at ", "on ", "date: ", "since "])
        elif kind == 8:
            value = "".join(r.choice(syllables) for _ in range(r.randint(4, 7))) + r.choice(["", "", ".", ",", ";"])
            before += r.choice(keys) + r.choice(join)
        elif kind == 9:
            value = r.choice(["", "-", "_"]).join(word() for _ in range(r.randint(5, 7)))
            before += r.choice(["the bearer ", "basic ", "Basic ", "of a bearer "])
        else:
            value = "".join(word() for _ in range(r.randint(3, 6))) + pick(string.digits, r.randint(1, 3))
            before += r.choice(["", "", 'name = "', "token ", "password "])
        out.append((value, before[-BEFORE:], after[:AFTER], 0))
    return out


# Features


def _classes(value: Column) -> Column:
    """The value with every character replaced by its class: vowel, consonant, capital, digit, sign."""
    out = F.regexp_replace(value, "[A-Z]", "C")
    out = F.regexp_replace(out, "[aeiouy]", "v")
    out = F.regexp_replace(out, "[b-df-hj-np-tw-xz]", "c")
    out = F.regexp_replace(out, "[0-9]", "d")
    return F.regexp_replace(out, "[^Cvcd]", "s")


def _pairs(classes: Column) -> Column:
    """Neighbouring characters; the last has none, and null. Positions are not looked up, so long values stay linear."""
    each = F.split(classes, "")
    return F.zip_with(each, F.slice(each, F.lit(2), F.size(each)), lambda a, b: F.concat(a, b))


@functools.lru_cache(maxsize=4)
def _odds(sample: tuple) -> dict[str, float]:
    """Log odds of each pair of character classes, secret to look-alike, from the labelled sample."""
    count = {0: {}, 1: {}}
    for value, _, _, label in sample:
        kinds = "".join("C" if c in string.ascii_uppercase else "v" if c in "aeiouy" else "c" if c in string.ascii_lowercase else "d" if c in string.digits else "s" for c in value)
        for i in range(len(kinds) - 1):
            count[label][kinds[i : i + 2]] = count[label].get(kinds[i : i + 2], 0) + 1
    total = {k: sum(v.values()) + 25 for k, v in count.items()}
    return {a + b: round(math.log((count[1].get(a + b, 0) + 1) / total[1]) - math.log((count[0].get(a + b, 0) + 1) / total[0]), 6) for a in "vcCds" for b in "vcCds"}


def features(value: Column, before: Column, after: Column, odds: dict[str, float]) -> list[Column]:
    """The features in the order of FEATURES, as doubles."""
    n = F.length(value).cast("double")
    kinds = _classes(value)
    table = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair])
    log_odds = F.transform(_pairs(kinds), lambda p: F.coalesce(F.element_at(table, p), F.lit(0.0)))
    known = F.length(F.regexp_replace(F.lower(value), "|".join(LISTED), ""))
    changes = F.length(F.regexp_replace(kinds, "(.)\\1*", "#")).cast("double")
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        n,
        F.aggregate(log_odds, F.lit(0.0), lambda a, x: a + x) / F.greatest(n - 1, F.lit(1.0)),
        changes / n,
        1 - known / n,
        yes(value.rlike("[a-z]/[a-z]|[a-z]\\.[a-z]{2,5}$|://") | before.rlike("[/@]$")) + F.length(F.regexp_replace(value, "[^/.]", "")) / n,
        F.length(F.regexp_replace(value, "[^0-9]", "")) / n,
        yes(value.rlike("^[0-9a-f]+$") & value.rlike("[a-f]")),
        yes(value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40.0)),
        yes(before.rlike(f"(?i)(?:{NAMES})[\"']?\\s*[:=]?\\s*[\"']?$")),
        yes(before.rlike("[:=]\\s*[\"']?$")),
        yes(before.rlike(f"(?i)\\b(?:{AGAINST})[\"']?\\s*[:=]?\\s*[\"']?$")),
        F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")) / n,
    ]


# The forest


class Forest:
    """A trained forest as arrays over all nodes: the feature and bound of a split, its two children, and a leaf's
    probability. Leaves lead to themselves, so a walk of DEPTH steps ends in one."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.roots: list[int] = []
        self.feature: list[int] = []
        self.bound: list[float] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.value: list[float] = []

    def add(self, node) -> int:
        """Takes over a node of a trained tree and all below it; its number."""
        at = len(self.value)
        for column, empty in ((self.feature, 0), (self.bound, 0.0), (self.low, at), (self.high, at), (self.value, 0.0)):
            column.append(empty)
        if node.subtreeDepth() == 0:
            stats = node.impurityStats().stats()
            self.value[at] = float(stats[1]) / max(1e-9, float(stats[0]) + float(stats[1]))
        else:
            split = node.split()
            self.feature[at], self.bound[at] = split.featureIndex(), float(split.threshold())
            self.low[at], self.high[at] = self.add(node.leftChild()), self.add(node.rightChild())
        return at

    def score(self, x: Column) -> Column:
        """The trees' mean probability, as an expression over a struct of features."""
        table = lambda values, kind: F.from_json(F.lit(str(values)), f"array<{kind}>")
        feature, bound, low, high = table(self.feature, "int"), table(self.bound, "double"), table(self.low, "int"), table(self.high, "int")
        leaf = table(self.value, "double")

        def walked(features: Column, root: Column) -> Column:
            step = lambda at, _: F.when(F.get(features, F.get(feature, at)) <= F.get(bound, at), F.get(low, at)).otherwise(F.get(high, at))
            return F.get(leaf, F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), root, step))

        total = lambda features: F.aggregate(F.transform(table(self.roots, "int"), lambda r: walked(features, r)), F.lit(0.0), lambda a, p: a + p)
        return F.get(F.transform(F.array(F.array(*[x[n] for n in FEATURES])), total), F.lit(0)) / F.lit(float(len(self.roots)))


_fitted: dict[int, Forest] = {}


def train(spark: SparkSession, labelled: list[tuple[str, str, str, int]] | None = None) -> Forest:
    """The forest of labelled findings, which must be a bounded sample: the default has 2,400 rows. A sample is fitted
    once; the forest holds plain numbers, so it serves any session of the process."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = tuple(labelled or findings())
    known = _fitted.get(hash(sample))
    if known is not None:
        return known
    odds = _odds(sample)
    rows = spark.createDataFrame(list(sample), "value string, before string, after string, label int").coalesce(1)
    cols = features(F.col("value"), F.col("before"), F.col("after"), odds)
    rows = rows.select(F.col("label").cast("double").alias("label"), *[c.cast("double").alias(n) for n, c in zip(FEATURES, cols, strict=True)])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(vectors)
    forest = Forest(odds)
    forest.roots = [forest.add(t._java_obj.rootNode()) for t in model.trees]
    _fitted[hash(sample)] = forest
    return forest


def with_findings(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """`docs` with __parts (text between candidates) and __found (array of value and score)."""
    tag = uuid.uuid4().hex[:6]
    raw, feats = f"__raw_{tag}", f"__feats_{tag}"
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(raw, F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)))
    df = df.withColumn("__parts", F.when(F.size(raw) > 0, F.split(t, CANDIDATE, -1)).otherwise(F.array(t)))

    def described(c, i):
        before = F.get("__parts", i)
        before = F.substring(before, F.greatest(F.length(before) - (BEFORE - 1), F.lit(1)), F.lit(BEFORE))
        after = F.substring(F.get("__parts", i + 1), 1, AFTER)
        cols = features(c, before, after, forest.odds)
        return F.struct(c.alias("value"), *[f.cast("double").alias(n) for n, f in zip(FEATURES, cols, strict=True)])

    df = df.withColumn(feats, F.transform(raw, described))
    df = df.withColumn("__found", F.transform(feats, lambda x: F.struct(x["value"].alias("value"), F.round(forest.score(x), 6).alias("score"))))
    return df.drop(raw, feats)


def _redacted(threshold: float) -> Column:
    shown = F.transform("__found", lambda x: F.when(x["score"] >= threshold, F.lit(MARK)).otherwise(x["value"]))
    return F.array_join(F.zip_with("__parts", shown, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")


def scanned(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of `docs`: doc_id, n_candidates, n_secrets, redacted_sha256."""
    forest = forest or train(docs.sparkSession)
    df = with_findings(docs.select("doc_id", "text"), forest)
    secrets = F.size(F.filter("__found", lambda x: x["score"] >= threshold)).cast("long")
    return df.select("doc_id", F.size("__found").cast("long").alias("n_candidates"), secrets.alias("n_secrets"), F.sha2(_redacted(threshold), 256).alias("redacted_sha256"))


def redacted(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns of `docs` with every secret in `text` replaced by a mark; n_chars, where there is one, follows."""
    forest = forest or train(docs.sparkSession)
    df = with_findings(docs, forest)
    df = df.withColumn("text", F.when(F.col("text").isNotNull(), _redacted(threshold)))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return df.select(docs.columns)
