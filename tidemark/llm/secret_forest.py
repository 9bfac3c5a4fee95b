"""Secret scan with a random forest against false positives, in DataFrame functions only.

Long runs of key characters are candidates: those with a digit, and those without one that a word
for secrets precedes. Their features (length, character transitions,
dictionary coverage, path and neighbouring words) are SQL expressions, the same for training and
scoring. The forest is grown in numpy on the driver from labelled findings and handed back as one
SQL expression, so a scan is a map over the documents without shuffle and without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh

#: A run of this many key characters at least, with its padding.
MIN_LENGTH = 16
CANDIDATE = rf"[A-Za-z0-9+/_\-]{{{MIN_LENGTH},}}+={{0,2}}"
#: Code points before and after a candidate in which its neighbours are looked for.
BEFORE, AFTER = 48, 16
REDACTED = "[SECRET]"
TREES, DEPTH, LEAST = 15, 6, 8

#: Fixed word lists, in natural order.
SECRET_WORDS = "token secret password passwd pwd api_key apikey api-key access_key private credential bearer auth signing client_secret webhook"
PLAIN_WORDS = "commit sha sha1 sha256 md5 checksum digest hash uuid guid revision version example sample dummy placeholder phone card order invoice isbn build image path file page id"
DICTIONARY = (
    "access account action admin answer apply article author backup begin between browser button cache change check "
    "class client cloud code color column comment config connect content context control count create current "
    "custom data database date default delete demo design detail device document domain download edit email empty "
    "enable error event example export failed field file filter first folder form format forward function general "
    "global group handler header hello help home host html http image import index info input insert install item "
    "java json key label language last layer layout library license line link list load local login main manager "
    "master media member memory menu message method model module month name network next node number object open "
    "option order output page panel param parent parse password path pattern place plain please plugin point "
    "position post preview print private process product profile project public python query read record release "
    "remove render replace report request reset resource response result return route sample save script search "
    "secret section select send server service session settings source sql start state static status step storage "
    "string style submit support switch system table target task template test text theme time title token tool "
    "type update upload user value version video view web window word work write your"
)
#: True of every text with a candidate: at least half of a run lies on one side of its digit, or a
#: word for secrets is in the text. One pass of it spares most texts the passes that place candidates.
LIKELY = rf"[0-9][A-Za-z0-9+/_\-]{{{MIN_LENGTH // 2},}}|[A-Za-z0-9+/_\-]{{{MIN_LENGTH // 2},}}[0-9]|(?i:{'|'.join(SECRET_WORDS.split())})"
FEATURES = ("length", "digits", "capitals", "transitions", "variety", "coverage", "slashes", "in_path", "secret_near", "plain_near", "assigned", "quoted")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(found: Column) -> Column:
    """Struct of FEATURES (doubles) for a struct (before, candidate, after)."""
    c = found["candidate"]
    n = F.length(c).cast("double")
    before, after = F.lower(found["before"]), found["after"]
    kinds = F.translate(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "B"), "+/_-=", "....."
    )
    changes = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(kinds, "a+", "a"), "0+", "0"), "B+", "B"), r"\.+", ".")) - 1
    words = "|".join(sorted((w for w in DICTIONARY.split()), key=lambda w: (-len(w), w)))
    values = {
        "length": F.length(c),
        "digits": _count(c, "[0-9]") / n,
        "capitals": _count(c, "[A-Z]") / n,
        "transitions": changes / n,
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
        "coverage": _count(F.lower(c), words) / n,
        "slashes": _count(c, "/") / n,
        "in_path": (before.rlike(r"[/\\.:~]$") | after.rlike(r"^(?:\.[A-Za-z]|/|\\)") | c.startswith("/")).cast("int"),
        "secret_near": before.rlike(_near(SECRET_WORDS)).cast("int"),
        "plain_near": before.rlike(_near(PLAIN_WORDS)).cast("int"),
        "assigned": before.rlike(r"[:=]\s*[\"']?$").cast("int"),
        "quoted": before.rlike("[\"'`]$").cast("int"),
    }
    return F.struct(*[values[k].cast("double").alias(k) for k in FEATURES])


def _near(listed: str) -> str:
    """A pattern for any of the words, standing alone."""
    return "(?:^|[^a-z0-9])(?:" + "|".join(sorted(listed.split(), key=lambda w: (-len(w), w))) + ")(?:$|[^a-z0-9])"


def _is_candidate(run: Column) -> Column:
    return run["candidate"].rlike("[0-9]") | F.lower(run["before"]).rlike(_near(SECRET_WORDS))


def runs(text: Column) -> Column:
    """A text cut at its runs of key characters: array of (gap, before, candidate, after), of which the
    last has no candidate. Gaps and candidates in turn are the text."""
    gaps = F.split(text, CANDIDATE)
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    return F.transform(
        F.arrays_zip(gaps.alias("gap"), F.slice(gaps, 2, 2**31 - 1).alias("follow"), found.alias("hit")),
        lambda x: F.struct(
            x["gap"].alias("gap"),
            F.right(x["gap"], F.lit(BEFORE)).alias("before"),
            x["hit"].alias("candidate"),
            F.substring(F.coalesce(x["follow"], F.lit("")), 1, AFTER).alias("after"),
        ),
    )


def candidates(text: Column) -> Column:
    """Array of (start, before, candidate, after) of a text."""
    listed = runs(text)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        listed,
        zero,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["candidate"]), F.lit(0))).alias("at"),
            F.array_append(acc["starts"], acc["at"] + F.length(x["gap"])).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    placed = F.zip_with(listed, starts, lambda x, at: F.struct(at.alias("start"), x["before"].alias("before"), x["candidate"].alias("candidate"), x["after"].alias("after")))
    return F.filter(placed, lambda x: x["candidate"].isNotNull() & _is_candidate(x))


# ---------------------------------------------------------------- the forest


@dataclass
class Node:
    share: float
    feature: int = -1
    bound: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> Node:
    node = Node(float(y.mean()))
    if depth == 0 or len(y) < 2 * LEAST or node.share in (0.0, 1.0):
        return node
    best = (1e-9, -1, 0.0)
    for k in rng.choice(x.shape[1], max(2, round(np.sqrt(x.shape[1]))), replace=False):
        order = np.argsort(x[:, k], kind="stable")
        v, t = x[order, k], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        cuts = cuts[(cuts >= LEAST) & (cuts <= len(y) - LEAST)]
        if not len(cuts):
            continue
        a, b = t[cuts - 1] / cuts, (t[-1] - t[cuts - 1]) / (len(y) - cuts)
        mixed = (cuts * a * (1 - a) + (len(y) - cuts) * b * (1 - b)) / len(y)
        gain = node.share * (1 - node.share) - mixed
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (float(gain[i]), int(k), float((v[cuts[i]] + v[cuts[i] - 1]) / 2))
    if best[1] < 0:
        return node
    low = x[:, best[1]] <= best[2]
    node.feature, node.bound = best[1], best[2]
    node.low, node.high = _grow(x[low], y[low], rng, depth - 1), _grow(x[~low], y[~low], rng, depth - 1)
    return node


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list[Node]:
    """Trees on bootstrap samples, a random choice of features at every split."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        forest.append(_grow(x[pick], y[pick], rng, depth))
    return forest


def forest_sql(forest: list[Node], struct: str) -> str:
    """The mean of the trees' shares as an SQL expression over a struct of FEATURES."""

    def one(node: Node) -> str:
        if node.feature < 0:
            return f"{node.share!r}D"
        return f"CASE WHEN {struct}.{FEATURES[node.feature]} <= {node.bound!r}D THEN {one(node.low)} ELSE {one(node.high)} END"

    return "(" + " + ".join(one(t) for t in forest) + f") / {float(len(forest))!r}D"


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Findings (before, candidate, after, label) made by rule from hashes of a row number.

    Secrets are hexadecimal, base64, mixed or letter-only keys, mostly beside a word that announces them; the
    others are digests, identifiers, paths, numbers, placeholders and names run together, some of
    them beside such words as well.
    """
    h = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    pick = lambda salt, n: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")
    of = lambda salt, listed: F.element_at(F.array(*[F.lit(w) for w in listed]), pick(salt, len(listed)) + 1)
    words = DICTIONARY.split()
    base64 = F.regexp_replace(F.base64(F.unhex(F.concat(h("b"), h("c")))), r"[\r\n]", "")
    lengths = F.element_at(F.array(*[F.lit(n) for n in (20, 24, 32, 32, 40, 40, 40, 48, 64)]), pick("len", 9) + 1)
    secret = F.element_at(
        F.array(
            F.substring(h("x"), F.lit(1), lengths),
            F.substring(base64, F.lit(1), lengths),
            F.concat(of("pre", ["sk_live_", "ghp_", "AKIA", "xoxb-", "glpat-", "key-"]), F.substring(F.regexp_replace(base64, "[+/=]", "x"), F.lit(1), lengths)),
            F.concat(F.substring(base64, 1, 42), F.lit("==")),
            F.substring(F.translate(base64, "0123456789+/=", "qzjxkvwpyhQZJ"), F.lit(1), lengths),
        ),
        pick("kind", 5) + 1,
    )
    number = F.regexp_replace(F.substring(F.conv(F.substring(h("n"), 1, 15), 16, 10), 1, 16), "^", "")
    names = F.concat(of("w1", words), F.lit("_"), of("w2", words), F.lit("_"), of("w3", words), F.lit("_"), pick("nn", 1000).cast("string"))
    paths = F.concat(F.lit("/"), of("w4", words), F.lit("/"), of("w5", words), F.lit("/"), of("w6", words), pick("nm", 90).cast("string"))
    uuid = F.regexp_replace(F.substring(h("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    hidden = F.concat(of("w7", ["your-", "my-", "example-", "test-"]), of("w8", ["api-key-here-1", "secret-token-123", "access-key-0000", "password-example1"]))
    other = F.element_at(
        F.array(F.substring(h("d"), F.lit(1), F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), pick("dl", 3) + 1)), F.lpad(number, 16, "4"), names, paths, uuid, hidden, F.lpad(F.lit("1"), 20, "x")),
        pick("other", 7) + 1,
    )
    good = pick("label", 2) == 1
    told = F.concat(of("s1", SECRET_WORDS.split()), of("s2", [" = \"", "=", ": ", ": \"", " = '", " "]))
    harmless = F.concat(of("p1", PLAIN_WORDS.split()), of("p2", [" ", ": ", "=", " = \""]))
    loose = F.concat(of("l1", words), F.lit(" "), of("l2", words), of("l3", [" ", " ", ". ", " (", "/", " \""]))
    #: A digest or number says what it is or stands alone; names and placeholders may follow a word for secrets.
    bland = F.when(pick("other", 7) >= 2, F.when(pick("b1", 3) == 0, told).otherwise(loose)).when(pick("b2", 2) == 0, harmless).otherwise(loose)
    lead = F.concat(of("f1", words), F.lit(" "), of("f2", words), F.lit(" "))
    return spark.range(rows).select(
        F.right(F.concat(lead, F.when(good, F.when(pick("t", 10) == 0, loose).otherwise(told)).otherwise(bland)), F.lit(BEFORE)).alias("before"),
        F.when(good, secret).otherwise(other).alias("candidate"),
        of("a1", ["\" ", "\n", " and", ".", "'", ".txt"]).alias("after"),
        good.cast("int").alias("label"),
    )


def fit(findings: DataFrame) -> list[Node]:
    """A forest from labelled findings (before, candidate, after, label), a table that people
    made and that fits the driver; nulls count as empty, rows without label are left out."""
    empty = F.lit("")
    made = findings.where("label in (0, 1)").select(
        F.struct(*[F.coalesce(F.col(k), empty).alias(k) for k in ("before", "candidate", "after")]).alias("found"), F.col("label").cast("int").alias("label")
    )
    rows = made.select(features(F.col("found")).alias("f"), "label").collect()
    if not rows:
        return [Node(0.0)]
    table = np.array([[*r.f, r.label] for r in rows], float)
    table = np.nan_to_num(table[np.lexsort(table.T)])
    return grow_forest(table[:, :-1], table[:, -1])


def scan(docs: DataFrame, forest: list[Node]) -> DataFrame:
    """One row per candidate: doc_id, start (code points before it), candidate, probability, is_secret.

    Whole texts are read. Null and empty texts have no candidates; repeated rows are scanned again;
    a null doc_id is kept; other columns are ignored.
    """
    found = docs.where(F.col("text").rlike(LIKELY)).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.explode(F.transform(candidates(F.col("text")), lambda x: F.struct(x["start"].alias("start"), x["candidate"].alias("candidate"), features(x).alias("f")))).alias("c"),
    )
    scored = found.select("doc_id", F.col("c.start").alias("start"), F.col("c.candidate").alias("candidate"), F.expr(forest_sql(forest, "c.f")).alias("probability"))
    return scored.withColumn("is_secret", F.col("probability") >= 0.5)


def redact(docs: DataFrame, forest: list[Node]) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by REDACTED; all rows and columns stay.

    Only the scored places are replaced. Texts without secrets, null and empty texts are unchanged.
    """
    text, name = F.col("text"), fresh(docs, "hits")
    hits = F.when(
        text.rlike(LIKELY),
        F.transform(runs(text), lambda x: F.struct(x["gap"].alias("gap"), x["candidate"].alias("hit"), F.when(x["candidate"].isNotNull() & _is_candidate(x), features(x)).alias("f"))),
    )
    secret = f"h.f IS NOT NULL AND {forest_sql(forest, 'h.f')} >= 0.5D"
    replaced = F.expr(f"array_join(transform(`{name}`, h -> concat(h.gap, CASE WHEN {secret} THEN '{REDACTED}' ELSE coalesce(h.hit, '') END)), '')")
    some = F.expr(f"exists(`{name}`, h -> {secret})")
    return docs.withColumn(name, hits).withColumn("text", F.when(some, replaced).otherwise(text)).drop(name)
