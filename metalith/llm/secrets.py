"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are what a key word is set to, from eight characters of any kind, and elsewhere
runs of sixteen or more key characters; names before an assignment sign and parts of a path are cut
off. Their features (length, character classes, how likely their letters follow each other
in the corpus, coverage by its common words, path signs, neighbouring words) are built-in
expressions. Letter transitions and common words are counted in all documents;
the forest is trained on the driver from a bounded set of labelled findings, found and measured
by the same expressions, and compiled into one CASE expression per tree. The scan is a projection
without shuffle or user code.
"""

from __future__ import annotations

import math
import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, read

#: Least length of a candidate, and of one that a key word is set to.
LEAST, LEAST_SET = 16, 8
GOOD_WORDS = "key|token|secret|passw|pwd|auth|credential|bearer|access|private|signature|apikey"
# the sign comes first: hardly any place in prose has one, and only there are key words looked for
_SIGN = r"[ \t]{0,2}[\"']?"
_NAMES = r"(?i:key|token|secret|passw|password|passwd|pwd|auth|credential|credentials|bearer)"
_SET = rf"(?:(?<=[=:]{_SIGN})(?<={_NAMES}[\"']?[ \t]{{0,2}}[=:]{_SIGN})|(?<=(?i:bearer) ))"
CANDIDATE = _SET + r"[^\s\"'<>,;=:][^\s\"'<>,;]{%d,}+|(?<![A-Za-z0-9_+\-])[A-Za-z0-9_+\-]{%d,}+={0,2}" % (LEAST_SET - 1, LEAST)
BEFORE, AFTER = 48, 24
TREES, DEPTH, THRESHOLD = 15, 7, 0.5
#: Labelled findings that the forest is trained on (150 bytes each).
MAX_LABELLED = 6_000
SEED = 23
#: Words that are taken, common ones first.
WORDS = 300
#: Words of placeholders, which count as known beside those of the corpus.
PLACEHOLDERS = (
    "example", "sample", "dummy", "test", "your", "here", "placeholder", "change", "default", "insert", "fake", "demo",
    "key", "token", "secret", "password", "user", "name", "abc", "xyz", "foo", "bar", "none", "null", "xxx", "123456", "000000",
)
BAD_WORDS = "commit|sha|hash|checksum|md5|digest|uuid|guid|revision|version|build|integrity|example|sample|etag|isbn|order|invoice|tracking|session id|trace"
FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "changes", "distinct", "transitions", "coverage", "hex_only",
    "path_signs", "path_around", "good_words", "bad_words", "assigned", "quoted", "known_prefix", "dashes",
)


@dataclass(frozen=True)
class Language:
    """Words, and 27 x 27 letters: how likely (0 to 60) a letter, or none, follows another."""

    words: tuple[str, ...] = PLACEHOLDERS
    table: str = "\x1e" * 729


def learn(docs: DataFrame, text_col: str = "text") -> Language:
    """Common words of four to ten letters and letter transitions, counted in all of ``docs``; at most WORDS words and 729
    counts reach the driver. Null texts count nothing; an empty table gives placeholders and even odds."""
    text = F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    found = docs.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words, at = Scratch(docs.sparkSession, "op4"), "words"
    found = words.put(found, at)
    common = found.where(F.length("w").between(4, 10) & (F.col("n") > 2)).orderBy(F.desc("n"), "w").limit(WORDS).collect()
    around = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    pairs = found.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(around, i, F.lit(2)))).alias("p"))
    counts = {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    words.drop(at)
    letters = " abcdefghijklmnopqrstuvwxyz"
    table = ""
    for x in letters:
        row = [counts.get(x + y, 0) + 0.5 for y in letters]
        table += "".join(chr(max(1, min(61, 61 + round(6 * math.log2(v / sum(row)))))) for v in row)
    return Language(tuple(dict.fromkeys((*PLACEHOLDERS, *sorted((r["w"] for r in common), key=len, reverse=True)))), table)


def _likelihood(low: Column, table: str) -> Column:
    """Mean place in the table of the pairs of neighbouring characters, in one pass over a candidate of any length."""
    places = F.split(F.lit(",".join(str(ord(x)) for x in table)), ",").cast("array<int>")
    codes = F.transform(F.split(low, ""), lambda ch: F.when(ch.between("a", "z"), F.ascii(ch) - 96).otherwise(0))

    def mean(k: Column) -> Column:
        pairs = F.zip_with(k, F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))), lambda x, y: F.coalesce(F.get(places, x * 27 + y), F.lit(0)))
        return F.aggregate(pairs, F.lit(0), lambda t, v: t + v) / F.greatest(F.size(k) - 1, F.lit(1))

    return let(codes, mean)


def features(before: Column, c: Column, after: Column, language: Language = Language()) -> Column:
    """A struct of FEATURES of a candidate between its neighbours, all doubles."""
    n = F.length(c)

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(c, pattern, ""))) / n

    low, near = F.lower(c), F.lower(before)
    flag = lambda x: x.cast("int").cast("double")
    values = {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "others": share("[A-Za-z0-9]").cast("double") * -1 + 1,
        "changes": F.regexp_count(c, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "transitions": _likelihood(low, language.table),
        "coverage": (n - F.length(F.regexp_replace(low, "|".join(language.words), ""))) / n,
        "hex_only": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "path_signs": F.regexp_count(c, F.lit("/")) / n,
        "path_around": flag(near.rlike(r"(https?:|www\.|file:|\./|/)[^\s]*$") | F.lower(after).rlike(r"^\.(html?|png|jpe?g|gif|css|js|py|txt|pdf|com|org|net)\b")),
        "good_words": flag(near.rlike(f"({GOOD_WORDS})[^a-z]*([a-z]+[^a-z]+)?$")),
        "bad_words": flag(near.rlike(f"({BAD_WORDS})[^a-z]*([a-z]+[^a-z]+)?$")),
        "assigned": flag(near.rlike("[=:]\\s*[\"']?$")),
        "quoted": flag(near.rlike("[\"']$") & after.rlike("^[\"']")),
        "known_prefix": flag(c.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^xox[abp]-|^sk[-_]|^eyJ")),
        "dashes": F.regexp_count(c, F.lit("[-_]")) / n,
    }
    return F.struct(*[F.coalesce(values[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES])


# -- labelled findings --------------------------------------------------------------------------


def labelled_findings(n: int = MAX_LABELLED, seed: int = SEED) -> list[dict]:
    """Findings with a label, drawn from fixed kinds of true and false ones: a start for a corpus whose
    findings nobody has reviewed yet. A table of reviewed findings (before, candidate, after,
    label) takes its place."""
    r = random.Random(seed)
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    draw = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve")) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6)))
    quote = lambda: r.choice(('"', "'", "", '"'))
    out = []
    for k in range(n):
        q = quote()
        name = r.choice(("token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "private key", "credential", "Authorization: Bearer"))
        if k % 2:
            kind = r.randrange(8)
            c = (
                draw(hexa, r.choice((32, 40, 64))), "AKIA" + draw(string.ascii_uppercase + "234567", 16), draw(alnum + "+/", r.randint(24, 64)),
                r.choice(("ghp_", "sk-", "xoxb-")) + draw(alnum, r.randint(24, 40)), draw(alnum, r.randint(16, 32)) + "1", draw(alnum + "_-", r.randint(20, 48)) + "7",
                draw(string.ascii_letters, r.randint(16, 40)), draw(alnum, 3) + r.choice("!@#$%&*") + draw(alnum + "!@#$%", r.randint(5, 12)),
            )[kind]
            if kind in (1, 3) and r.random() < 0.6:
                before, after = prose() + " ", " " + prose()
            else:
                before, after = prose() + " " + name + r.choice((" = ", "=", ": ", " = ") if kind in (5, 6, 7) else (" = ", "=", ": ", " ")) + q, q + r.choice((" ", ";", ",", "\n")) + prose()
        else:
            kind = r.randrange(12)
            before, after = prose() + " ", " " + prose()
            bad = r.choice(("commit", "sha", "checksum", "md5", "digest", "revision", "build", "hash", "etag", "version"))
            if kind == 0:
                c, before = draw(hexa, r.choice((32, 40, 64))), prose() + " " + bad + r.choice((" ", ": ", "="))
            elif kind == 1:
                c, before = "-".join(draw(hexa, m) for m in (8, 4, 4, 4, 12)), prose() + r.choice((" uuid ", " id=", " trace "))
            elif kind == 2:
                c, before, after = "/".join(word() for _ in range(r.randint(3, 6))) + str(r.randrange(100)), r.choice(("https://", "./", "/")), r.choice((".html", ".png", ".py", "/"))
            elif kind == 3:
                c, before = r.choice(("your", "example", "dummy", "test", "sample")) + r.choice("_-") + r.choice(("api", "secret", "token")) + "_key_here_" + str(r.randrange(1000)), name + " = " + q
            elif kind == 4:
                c = "-".join((word() + word(), word(), word() + word(), str(r.randrange(10000))))
            elif kind == 5:
                c = draw(string.digits, r.randint(16, 24))
            elif kind == 6:
                c = f"{r.randrange(2000, 2030)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}-{word()}-{word()}-{word()}"
            elif kind == 7:
                c, before = r.choice("x0a1") * r.randint(16, 40) + "0", name + " = " + q
            elif kind == 8:
                c = r.choice("=-_+") * r.randint(16, 60) + str(r.randrange(10)) + r.choice("=-_+") * 3
            elif kind == 10:
                c, before = word() + word() + word() + word() + word() + word() + word() + word(), prose() + " "
                c += "a" * max(0, LEAST - len(c))
            elif kind == 11:
                c, before, after = r.choice((word() * 3 + "able", "required", "optional", "see.below", "disabled", "<none>x1", "${" + name.upper().replace(" ", "_") + "}", "process.env." + name.upper().replace(" ", "_"))), name + r.choice((": ", " = ")), " " + prose()
                c += "s" * max(0, LEAST_SET - len(c))
            else:
                c = word() + word() + word() + word() + "".join(map(str, r.sample(range(10), 2))) + word() + word() + word()
                c = c if len(c) >= LEAST else c + "0123456789abcdef"[: LEAST - len(c)]
        out.append({"before": before[-BEFORE:], "candidate": c, "after": after[:AFTER], "label": k % 2})
    return out


# -- forest -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> Node:
    share = float(y.mean())
    if depth == 0 or len(y) < 8 or share in (0.0, 1.0):
        return Node(share)
    best = (2.0, -1, 0.0)
    for f in rng.choice(x.shape[1], size=int(np.ceil(np.sqrt(x.shape[1]))), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, pos = x[order, f], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        if len(k):
            a, b = pos[k - 1] / k, (pos[-1] - pos[k - 1]) / (len(y) - k)
            gini = (k * a * (1 - a) + (len(y) - k) * b * (1 - b)) * 2 / len(y)
            j = int(gini.argmin())
            best = min(best, (float(gini[j]), int(f), float((v[k[j]] + v[k[j] - 1]) / 2)))
    if best[1] < 0:
        return Node(share)
    side = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], _grow(x[side], y[side], depth - 1, rng), _grow(x[~side], y[~side], depth - 1, rng))


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Node]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows].astype(float), depth, rng))
    return out


def _sql(node: Node, prefix: str) -> str:
    if node.feature < 0:
        return f"{node.share!r}D"
    return f"CASE WHEN {prefix}.{FEATURES[node.feature]} <= {node.cut!r}D THEN {_sql(node.low, prefix)} ELSE {_sql(node.high, prefix)} END"


def compiled(forest: list[Node], prefix: str) -> Column:
    """Mean vote of the trees as one expression over the struct column ``prefix``."""
    return F.expr(f"({' + '.join(_sql(t, prefix) for t in forest)}) / {len(forest)}")


@dataclass(frozen=True)
class Model:
    forest: list[Node]
    language: Language = Language()


def fit(spark: SparkSession, findings: list[dict] | None = None, language: Language = Language()) -> Model:
    """Train from labelled findings, at most MAX_LABELLED of them, as the scan would find them: each is laid
    in its text and what ``candidates`` finds there is measured. What overlaps the finding has its label,
    anything else that is found is false."""
    rows = (findings if findings is not None else labelled_findings())[:MAX_LABELLED]
    table = spark.createDataFrame([(r["before"] + r["candidate"] + r["after"], len(r["before"]), len(r["before"]) + len(r["candidate"]), r["label"]) for r in rows], "text string, a long, b long, label int")
    found = candidates(table, "text", "a", "b", "label", language=language)
    over = (F.col("start") < F.col("b")) & (F.col("start") + F.length("candidate") > F.col("a"))
    found = found.select(F.col("_f").alias("f"), F.when(over, F.col("label")).otherwise(0).alias("y")).select("f.*", "y")
    got = np.array([tuple(r) for r in found.collect()], dtype=float).reshape(-1, len(FEATURES) + 1)
    return Model(train_forest(got[:, :-1], got[:, -1]) if len(got) else [Node(0.0)], language)


# -- scan ---------------------------------------------------------------------------------------


def candidates(docs: DataFrame, text_col: str = "text", *keep: str, language: Language = Language()) -> DataFrame:
    """``keep``, ``ordinal``, ``start`` (characters before), ``candidate``, ``_f`` of each candidate."""
    text = F.col(f"`{text_col}`")
    rows = docs.where(text.rlike(CANDIDATE)).select(*keep, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_c"), F.split(text, CANDIDATE, -1).alias("_g"))
    # one pass over the row's candidates says where each starts
    at = lambda s, i: s["end"] + F.length(F.get("_g", i))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
    run = F.aggregate(F.sequence(F.lit(0), F.size("_c") - 1), start, lambda s, i: F.struct((at(s, i) + F.length(F.get("_c", i))).alias("end"), F.concat(s["at"], F.array(at(s, i))).alias("at")))
    rows = rows.select(*keep, "_c", "_g", run["at"].alias("_s"))
    one = F.transform("_c", lambda c, i: F.struct(i.alias("ordinal"), F.get("_s", i).cast("long").alias("start"), c.alias("candidate"), F.right(F.get("_g", i), F.lit(BEFORE)).alias("before"), F.left(F.get("_g", i + 1), F.lit(AFTER)).alias("after")))
    rows = rows.select(*keep, F.explode(one).alias("x")).select(*keep, "x.*")
    return rows.withColumn("_f", features(F.col("before"), F.col("candidate"), F.col("after"), language)).drop("before", "after")


def scan(docs: DataFrame, model: Model, text_col: str = "text", *keep: str) -> DataFrame:
    """Findings: ``keep``, ordinal, start, candidate, score, is_secret. Null and empty texts
    have none; repeated rows have theirs each; an empty table gives an empty result."""
    rows = candidates(docs, text_col, *keep, language=model.language)
    return rows.withColumn("score", compiled(model.forest, "_f")).drop("_f").withColumn("is_secret", F.col("score") > THRESHOLD)


def redact(docs: DataFrame, model: Model, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``, same columns, in one projection. Null and
    empty texts stay; repeated rows are cut each; an empty table stays empty."""
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    t = F.col(names[text_col])
    c, g = F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), F.split(t, CANDIDATE, -1)

    def shown(c: Column, g: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            f = features(F.right(F.get(g, i), F.lit(BEFORE)), x, F.left(F.get(g, i + 1), F.lit(AFTER)), model.language)
            vote = let(f, lambda s: _votes(model.forest, s))
            return F.concat(F.when(vote > THRESHOLD, F.lit(mark)).otherwise(x), F.get(g, i + 1))

        return F.concat(F.get(g, F.lit(0)), F.array_join(F.transform(c, one), ""))

    cut = let(c, lambda cs: let(g, lambda gs: shown(cs, gs)))
    inner = inner.withColumn(names[text_col], F.when(t.rlike(CANDIDATE), cut).otherwise(t))
    return inner.select(*[F.col(a).alias(c) for c, a in names.items()])


def _votes(forest: list[Node], s: Column) -> Column:
    def vote(n: Node) -> Column:
        if n.feature < 0:
            return F.lit(n.share)
        return F.when(s[FEATURES[n.feature]] <= n.cut, vote(n.low)).otherwise(vote(n.high))

    total = vote(forest[0])
    for t in forest[1:]:
        total = total + vote(t)
    return total / len(forest)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, fit(spark, language=learn(docs)), "text", "doc_id")
    return out.select("doc_id", "ordinal", "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
