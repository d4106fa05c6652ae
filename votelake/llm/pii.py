"""Personal data: generators propose spans, boosted trees select the redactions.

Base kinds (email, ip, card, phone) are fixed patterns with a check each; what
passes always stays.  Three generators of high recall propose more, overlapping
as they may: ``mail`` (addresses written with at and dot in words, brackets or
spaces), ``number`` (groups of digits: telephone numbers without a plus
sign, national ids and the like) and ``secret`` (unbroken runs of letters and
digits: keys, tokens, passwords).  Boosted trees score each proposal from its
format and its context, a logistic fit on other rows calibrates the score, and
each generator has the least threshold at which calibration rows reach
``PRECISION``.  A chosen span that overlaps a base span, or one of the
generator before it, goes.

Trees are fitted on ``SAMPLE`` rows written by the SQL in ``practice`` (no
corpus holds labels of spans); their features are counted by a DataFrame
query, so only a few hundred distinct combinations reach the driver, and the
fitted trees become one SQL expression.  Everything over documents is
DataFrame and SQL functions: one scan, one narrow shuffle by row.

Edge cases: a null text is empty and has no span; equal texts have equal
spans; offsets are code points, ends exclusive; patterns are possessive, so a
run of any length is scanned once and never recursed into, so very long texts
are read whole; of spans that begin together the longer match of a kind
counts, and of kinds the one named first; repeated rows are kept apart by a
row number; a null doc_id is kept; other columns, whatever their names, are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = 9000
ROUNDS = 30
DEPTH = 3
RATE = 0.3
PRECISION = 0.98
LEFT, RIGHT = 24, 12

BASE = ("email", "ip", "card", "phone")
GENERATORS = ("mail", "number", "secret")

_LOCAL = "A-Za-z0-9._%+-"
#: Equal to the plain patterns of the contract: a match may begin after a character of its own first class only where the match before ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail": rf"(?i)(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++(?:\x20?@\x20?|\x20?[\[({{]\x20?at\x20?[\])}}]\x20?|\x20at\x20)[a-z0-9-]++(?:(?:\x20?\.\x20?|\x20?[\[({{]\x20?dot\x20?[\])}}]\x20?|\x20dot\x20)[a-z0-9-]++)++",
    "number": r"(?:\G|(?<![0-9A-Za-z]))\(?[0-9](?:[\x20().\x2F-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])",
    "secret": r"(?:\G|(?<![A-Za-z0-9_/+-]))(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{8,}+={0,2}",
}
_AT, _DOT = r"\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20", r"\x20?\.\x20?|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20"
#: Texts without these hold no match, which a plain scan tells sooner. That of ``mail`` is a part of each of its matches.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike("[0-9]"),
    "card": lambda t: t.rlike("[0-9]"),
    "phone": lambda t: t.contains("+"),
    "mail": lambda t: t.contains("@") | t.rlike(rf"(?i)(?:{_AT})[a-z0-9-]++(?:{_DOT})[a-z0-9-]"),
    "number": lambda t: t.rlike("[0-9]"),
    "secret": lambda t: t.rlike("[0-9][_/+-]*+[A-Za-z]|[A-Za-z][_/+-]*+[0-9]"),
}


def luhn(digits: Column) -> Column:
    """Whether a string of decimal digits passes the Luhn check."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    number = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    total = F.aggregate(F.transform(number, lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d)), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    """The check of each base kind; false for the generators."""
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", n.between(16, 19) & luhn(F.substring(digits, 1, 19)))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(False)
    )


def proposals(docs: DataFrame, kinds: tuple[str, ...], keep: list[str]) -> DataFrame:
    """A row for each match of each kind, or one with a null kind where a text has none.

    A match carries its number within the text and the length of text before
    it since the last match; sums of those give offsets later.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, text.alias("__t"))
    for k in kinds:
        found = NEEDS[k](F.col("__t"))
        base = base.withColumn(f"__m_{k}", F.when(found, F.regexp_extract_all("__t", F.lit(PATTERNS[k]), F.lit(0))))
    for k in kinds:
        base = base.withColumn(f"__s_{k}", F.when(F.size(f"__m_{k}") > 0, F.split("__t", PATTERNS[k], -1)))

    def spans(k: str) -> Column:
        gaps = F.col(f"__s_{k}")
        row = lambda m, i: F.struct(
            F.lit(k).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), m.alias("value"), F.right(F.get(gaps, i), F.lit(LEFT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(RIGHT)).alias("after")
        )
        return F.coalesce(F.transform(F.col(f"__m_{k}"), row), F.array().cast("array<struct<kind:string,i:int,gap:int,value:string,before:string,after:string>>"))

    return base.select(*keep, F.explode_outer(F.concat(*[spans(k) for k in kinds])).alias("x")).select(*keep, "x.*")


def features() -> dict[str, Column]:
    """Format and context of a proposal as small integers."""
    v, left, right = F.col("value"), F.lower("before"), F.lower("after")
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    has = lambda c: c.cast("int")
    return {
        "digits": F.least(digits, F.lit(20)),
        "length": F.least(F.floor(F.length(v) / 4), F.lit(10)).cast("int"),
        "marks": F.least(F.length(F.regexp_replace(v, "[0-9A-Za-z]", "")), F.lit(8)),
        "zero": has(v.startswith("0")),
        "bracket": has(v.rlike(r"^\([0-9]{3,4}\)|[\[({]")),
        "words": has(v.rlike(r"(?i)\Wat\W.*\Wdot\W")),
        "sign": has(v.contains("@")),
        "domain": has(v.rlike(r"(?i)(?<![a-z0-9-])(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|us)$")),
        "threes": has(v.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")),
        "social": has(v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "date": has(v.rlike(r"^(?:19|20)[0-9]{2}[-./\x20][0-9]{1,2}[-./\x20][0-9]{1,2}$|^[0-9]{1,2}[-./\x20][0-9]{1,2}[-./\x20](?:19|20)[0-9]{2}$")),
        "thousands": has(v.rlike(r"^[0-9]{1,3}(?:[\x20.][0-9]{3})+$")),
        "ask_call": has(left.rlike(r"(?:phone|tel|call|fax|mobile|cell|whatsapp|dial)[a-z.]{0,6}\W{0,4}(?:me|us|at|on|is|no)?\W{0,4}(?:at|on|is)?\W{0,3}$")),
        "ask_mail": has(left.rlike(r"(?:mail|contact|write|reach|address)[a-z]{0,4}\W{0,4}(?:me|us|at|to|is)?\W{0,4}(?:at|to|is)?\W{0,3}$")),
        "ask_id": has(left.rlike(r"(?:ssn|social security|passport|national id|tax id|insurance)[a-z]{0,4}\W{0,4}(?:no|number|is)?\W{0,4}$")),
        "other": has(left.rlike(r"(?:version|page|isbn|order|price|total|invoice|figure|table|serial|part)[a-z.]{0,4}\W{0,4}(?:no|number|is)?\W{0,4}$|[$#=]\W?$")),
        "more": has(right.rlike(r"^\W?[0-9$%=/]")),
        "hexes": has(v.rlike(r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,})$")),
        "classes": has(v.rlike("[a-z]")) + has(v.rlike("[A-Z]")) + has(v.rlike("[0-9]")),
        "turns": F.least(F.regexp_count(v, F.lit("[A-Za-z][0-9]")), F.lit(6)),
        "issuer": has(v.rlike(r"^(?:AKIA|ASIA|AIza|gh[opsu]_|github_pat_|glpat-|sk[-_]|xox[abp]-|eyJ)")),
        "ask_secret": has(left.rlike(r"(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|(?:access|private)[ _-]?key|auth|bearer|credential)[a-z_]{0,8}[\"']?\s{0,2}(?:[:=]|is)?\s{0,2}[\"'`]?$")),
        "ask_hash": has(left.rlike(r"(?:commit|sha-?[0-9]{0,3}|md5|checksum|digest|etag|hash|uuid|revision|blob|tree)[\"']?\s{0,2}(?:[:=]|is)?\s{0,2}[\"'`]?$")),
    }


def practice(spark: SparkSession, rows: int = SAMPLE) -> DataFrame:
    """Labelled texts, each with one proposal of the generator ``aim``, written by rule from row numbers."""
    pick = lambda salt, values: F.element_at(F.array(*[F.lit(x) for x in values]), (F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    d = F.translate(F.md5(F.concat(F.lit("n"), F.col("id").cast("string"))), "abcdef", "927183")
    s = lambda a, n: F.substring(d, a, n)
    name = F.concat(pick("n", ["ana", "jo.lee", "m_rossi", "k-meyer", "info", "ines"]), F.when(F.col("id") % 3 == 0, s(1, 2)).otherwise(F.lit("")))
    host, tld = pick("h", ["post", "mail7", "example", "uni-x", "web"]), pick("t", ["com", "org", "net", "de", "fr", "es"])
    word = lambda salt: pick(salt, ["there", "noon", "look", "that", "matrix", "home", "le", "product", "ing", "thea"])
    call, mail, ident = pick("c", ["call me on ", "phone: ", "tel. ", "mobile ", "fax "]), pick("m", ["mail me at ", "contact: ", "write to ", "reach us at "]), pick("i", ["ssn ", "passport no ", "national id ", "social security number "])
    plain, other = pick("p", ["the ", "of ", "and then ", "une ", "der ", "it was "]), pick("o", ["version ", "order no ", "isbn ", "total ", "invoice ", "page "])
    year = F.concat(F.lit("20"), F.lpad((F.col("id") % 25).cast("string"), 2, "0"))
    month, day = F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")
    c = F.concat
    hexes = c(F.md5(c(F.lit("x"), F.col("id").cast("string"))), s(1, 8))
    mixed = F.translate(F.base64(F.unhex(c(F.md5(c(F.lit("y"), F.col("id").cast("string"))), F.md5(c(F.lit("z"), F.col("id").cast("string")))))), "+/=", "kQ")
    m = lambda n: F.substring(mixed, 1, n)
    key = pick("k", ["token = ", "secret: ", "api_key=", "apikey = ", "access_token: ", "auth_token=", "private_key = "])
    entry, check = pick("w", ["password = ", "passwd: ", "pwd=", "password is "]), pick("x", ["commit ", "sha256: ", "md5 ", "checksum ", "etag=", "digest "])
    quote = pick("q", ['"', "'", ""])
    good = [
        c(call, s(1, 3), F.lit("-"), s(4, 3), F.lit("-"), s(7, 4)),
        c(call, F.lit("("), s(1, 3), F.lit(") "), s(4, 3), F.lit("-"), s(7, 4)),
        c(plain, F.lit("("), s(1, 3), F.lit(") "), s(4, 3), F.lit("-"), s(7, 4)),
        c(call, F.lit("0"), s(1, 4), F.lit(" "), s(5, 6)),
        c(call, s(1, 3), F.lit("."), s(4, 3), F.lit("."), s(7, 4)),
        c(ident, s(1, 3), F.lit("-"), s(4, 2), F.lit("-"), s(6, 4)),
        c(plain, s(1, 3), F.lit("-"), s(4, 2), F.lit("-"), s(6, 4)),
        c(ident, s(1, 9)),
        c(mail, name, F.lit(" at "), host, F.lit(" dot "), tld),
        c(plain, name, F.lit(" [at] "), host, F.lit(" [dot] "), tld),
        c(plain, name, F.lit("(at)"), host, F.lit("(dot)"), tld),
        c(mail, name, F.lit(" @ "), host, F.lit(" . "), tld),
    ]
    bad = [
        c(plain, year, F.lit("-"), month, F.lit("-"), day),
        c(plain, day, F.lit("."), month, F.lit("."), year),
        c(plain, day, F.lit("/"), month, F.lit("/"), year),
        c(other, s(1, 9)),
        c(other, s(1, 3), F.lit("-"), s(4, 1), F.lit("-"), s(5, 4), F.lit("-"), s(9, 2)),
        c(plain, s(1, 3), F.lit(" "), s(4, 3), F.lit(" "), s(7, 3)),
        c(plain, s(1, 16)),
        c(plain, s(1, 3), F.lit("."), s(4, 3), F.lit("."), s(7, 3), F.lit("."), s(10, 2)),
        c(plain, s(1, 7)),
        c(plain, s(1, 10)),
        c(plain, s(1, 4), F.lit("-"), s(5, 4)),
        c(word("a"), F.lit(" at "), word("b"), F.lit(" dot "), word("d")),
        c(plain, word("a"), F.lit(" at "), word("b"), F.lit(". "), word("d")),
        c(other, word("a"), F.lit(" @ "), s(1, 2), F.lit("."), s(3, 2)),
    ]
    good_secrets = [
        c(key, quote, hexes, quote),
        c(key, quote, m(24), quote),
        c(key, quote, m(40), quote),
        c(entry, quote, pick("f", ["Trout", "winter", "Qwerty_", "blue-moon"]), s(1, 4), quote),
        c(F.lit("authorization: bearer "), m(36)),
        c(plain, F.lit("AKIA"), F.upper(m(16))),
        c(plain, F.lit("ghp_"), m(36)),
    ]
    bad_secrets = [
        c(check, hexes),
        c(check, F.substring(hexes, 1, 32)),
        c(plain, hexes),
        c(plain, pick("g", ["img", "scan", "report_", "covid-19-v", "file"]), year, month, day),
        c(other, pick("g", ["item", "model-", "build", "x86_64-r", "mp3-rev"]), s(1, 6)),
        c(plain, pick("g", ["item", "model-", "build", "covid-19", "mp3-rev"]), s(1, 6)),
        c(F.lit("id="), pick("g", ["item", "page", "node"]), s(1, 8)),
        c(plain, name, s(1, 4), F.lit("_"), word("a")),
    ]
    of = lambda x: "mail" if any(x is y for y in (*good[8:], *bad[-3:])) else "number"
    made = [(x, 1, of(x)) for x in good] + [(x, 0, of(x)) for x in bad] + [(x, 1, "secret") for x in good_secrets] + [(x, 0, "secret") for x in bad_secrets]
    kinds = [F.struct(x.alias("text"), F.lit(y).alias("label"), F.lit(k).alias("aim")) for x, y, k in made]
    which = F.pmod(F.xxhash64(F.col("id"), F.lit("kind")), F.lit(len(kinds))) + 1
    drawn = spark.range(0, rows, 1, 4).select("id", F.element_at(F.array(*kinds), which.cast("int")).alias("x"))
    tail = pick("end", [". ", " ", ", and", "!", " the"])
    return drawn.select("id", F.concat("x.text", tail).alias("text"), "x.label", "x.aim", (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(3)) == 0).alias("calibrate"))


Tree = tuple  # ("leaf", value) or (feature, cut, low, high)


def grow(rows: list[tuple[dict[str, int], float, float]], depth: int) -> Tree:
    """A regression tree on (features, gradient, curvature) by Newton gain."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth:
        for name in rows[0][0]:
            sums: dict[int, list[float]] = {}
            for x, gi, hi in rows:
                at = sums.setdefault(x[name], [0.0, 0.0])
                at[0] += gi
                at[1] += hi
            left_g = left_h = 0.0
            for cut in sorted(sums)[:-1]:
                left_g, left_h = left_g + sums[cut][0], left_h + sums[cut][1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = gain, name, cut
    if best is None:
        return "leaf", round(RATE * g / (h + 1), 6)
    _, name, cut = best
    return name, cut, grow([r for r in rows if r[0][name] <= cut], depth - 1), grow([r for r in rows if r[0][name] > cut], depth - 1)


def value_of(tree: Tree, x: dict[str, int]) -> float:
    while tree[0] != "leaf":
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[1]


def as_sql(tree: Tree) -> str:
    if tree[0] == "leaf":
        return repr(float(tree[1])) + "D"
    return f"CASE WHEN `{tree[0]}` <= {tree[1]} THEN {as_sql(tree[2])} ELSE {as_sql(tree[3])} END"


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


class Selector:
    """Trees, calibration and thresholds as one SQL expression of the features."""

    def __init__(self, counted: list[tuple[str, dict[str, int], int, bool, int]]):
        """``counted``: generator, features, label, whether for calibration, number of rows."""
        self.trees: dict[str, list[Tree]] = {}
        self.slope: dict[str, tuple[float, float]] = {}
        self.threshold: dict[str, float] = {}
        for kind in GENERATORS:
            learn = [(x, y, n) for k, x, y, cal, n in counted if k == kind and not cal]
            check = [(x, y, n) for k, x, y, cal, n in counted if k == kind and cal]
            trees, total = [], [0.0] * len(learn)
            for _ in range(ROUNDS if learn else 0):
                p = [sigmoid(s) for s in total]
                trees.append(grow([(x, n * (y - q), n * q * (1 - q)) for (x, y, n), q in zip(learn, p, strict=True)], DEPTH))
                total = [s + value_of(trees[-1], x) for s, (x, _, _) in zip(total, learn, strict=True)]
            a, b = 1.0, 0.0
            scored = [(sum(value_of(t, x) for t in trees), y, n) for x, y, n in check]
            for _ in range(25):  # Newton steps of a logistic fit with a small prior
                ga, gb, haa, hab, hbb = -0.1 * (a - 1), -0.1 * b, 0.1, 0.0, 0.1
                for s, y, n in scored:
                    q = sigmoid(a * s + b)
                    w = n * q * (1 - q)
                    ga, gb, haa, hab, hbb = ga + n * (y - q) * s, gb + n * (y - q), haa + w * s * s, hab + w * s, hbb + w
                det = haa * hbb - hab * hab
                a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
            self.trees[kind], self.slope[kind] = trees, (round(a, 6), round(b, 6))
            fitting = [1.0]
            ranked = sorted(((sigmoid(a * s + b), y, n) for s, y, n in scored), reverse=True)
            hit = seen = 0
            for i, (q, y, n) in enumerate(ranked):
                hit, seen = hit + y * n, seen + n
                if (i + 1 == len(ranked) or ranked[i + 1][0] < q) and q >= 0.5 and hit >= PRECISION * seen:
                    fitting.append(q)
            self.threshold[kind] = round(min(fitting) - 1e-6, 6)

    def probability(self, kind: str) -> Column:
        a, b = self.slope[kind]
        total = " + ".join(f"({as_sql(t)})" for t in self.trees[kind]) or "0.0D"
        return 1 / (1 + F.exp(-(F.lit(a) * F.expr(total) + F.lit(b))))

    def chosen(self) -> Column:
        pick = F.lit(False)
        for kind in GENERATORS:
            pick = F.when(F.col("kind") == kind, self.probability(kind) >= self.threshold[kind]).otherwise(pick)
        return pick


def fit(spark: SparkSession, rows: int = SAMPLE) -> Selector:
    """Counts the features of the practice texts and fits; deterministic."""
    f = features()
    found = proposals(practice(spark, rows), GENERATORS, ["id", "label", "aim", "calibrate"]).filter("kind = aim")
    counted = found.select("kind", "label", "calibrate", *[c.alias(n) for n, c in f.items()]).groupBy("kind", "label", "calibrate", *f).count()
    got = sorted((r["kind"], tuple(r[n] for n in f), r["label"], r["calibrate"], r["count"]) for r in counted.collect())
    return Selector([(k, dict(zip(f, x, strict=True)), y, c, n) for k, x, y, c, n in got])


def find(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """A row for each row of docs: doc_id and ``found``, its spans in order (kind number, kind, start, end)."""
    selector = selector or fit(docs.sparkSession)
    kinds = BASE + GENERATORS
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__r"))
    matches = proposals(rows, kinds, ["__r", "doc_id"])
    is_base = F.col("kind").isin(*BASE)
    scored = matches.select("*", *[F.when(F.col("kind").isin(*GENERATORS), c).alias(n) for n, c in features().items()])
    scored = scored.select("__r", "doc_id", "kind", "i", "gap", F.length("value").alias("len"), F.when(is_base, passes(F.col("kind"), F.col("value"))).otherwise(F.coalesce(selector.chosen(), F.lit(False))).alias("ok"))
    scored = scored.repartition("__r")
    so_far = Window.partitionBy("__r", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = scored.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far).cast("long")).withColumn("start", F.col("end") - F.col("len"))
    placed = placed.filter("ok or kind is null or i = 0")  # the first match of a kind keeps rows whose matches all fail
    number = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")), F.lit(0))
    placed = placed.withColumn("no", F.when(F.col("ok"), number).otherwise(0))
    earlier = Window.partitionBy("__r").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("__r").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    for before in range(len(BASE), len(kinds)):
        kind = before + 1
        firm = F.col("no").between(1, before)
        clash = (F.coalesce(F.max(F.when(firm, F.col("end"))).over(earlier), F.lit(0)) > F.col("start")) | (F.coalesce(F.min(F.when(firm, F.col("start"))).over(later), F.lit(1 << 60)) < F.col("end"))
        placed = placed.withColumn("__c", clash).withColumn("no", F.when((F.col("no") == kind) & F.col("__c"), 0).otherwise(F.col("no"))).drop("__c")
    span = F.when(F.col("no") > 0, F.struct(F.col("no"), F.col("start"), F.col("end"), F.col("kind")))
    return placed.groupBy("__r").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("found")).drop("__r")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(found: str, number: int) -> Column:
    return F.size(F.filter(found, lambda x: x["no"] == number)).cast("long")


def redact(text: Column, found: Column, mark: str = "[{}]") -> Column:
    """The text with its spans replaced by their kinds; overlapping spans are merged under the first one's kind."""
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"], -x["end"], x["kind"])))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, x: Column) -> Column:
        end, kind = -x["col2"], x["kind"]
        fresh = F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.concat(F.lit(mark.split("{}")[0]), F.upper(kind), F.lit(mark.split("{}")[1])))
        return F.when(x["start"] >= a["at"], F.struct(fresh.alias("out"), end.alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], end).alias("at")))

    done = F.aggregate(ordered, start, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda x: x["no"] <= len(BASE))
    counts = [count_of("found", n).alias(f"n_{k}") for n, k in enumerate(BASE + GENERATORS, 1)]
    return found.select("doc_id", *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))
