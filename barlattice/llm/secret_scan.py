"""Secrets: patterns, and tokens that are random by a battery of tests and not ordinary by their letters.

Candidates are whole tokens of ``MIN_LENGTH`` characters or more, also values after '='. '-' and '_'
join the parts of a token and are not tested; what is left, ``MIN_TESTED`` characters or more, has the
first of ``ALPHABETS`` that holds it, so every token has one. That a token is random is tested three
ways: chi-squared of its characters against the uniform alphabet, runs above and below the middle of
the alphabet, and correlation of neighbours. A token whose smallest p-value, times three, is below
``NOT_RANDOM`` is dismissed.

What is left is held against ordinary tokens: pairs of neighbouring characters counted on the distinct
words of all texts, mixed with single letters (``PAIRS`` and ``PRIOR``), give the chance of a token, and
its mean and spread given the characters before. The p-value is that of so small a chance. Within each
group of an alphabet and a length class, the step-up procedure of Benjamini and Hochberg finds the
tokens that are not ordinary, at the false-discovery rate ``RATE``: these are reported, so the rate
bounds the false alarms. Groups by length keep short tokens from borrowing the threshold of long ones.
The procedure needs the number of p-values below each value of a grid of ``GRID`` logarithmic steps,
so it is one aggregation and never a sort of all tokens.

Defined cases: null and empty texts have no spans; a token that is used often is one hypothesis;
texts without words leave the single letters of ``PRIOR``; rows that repeat an id are searched one by
one; an empty table gives an empty result; long texts are searched whole, and a token of any length
is tested whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlattice.llm.common import ascii_lower, whole_text, with_group_values, written
from barlattice.llm.native_spans import joined, matches, of_kind

#: The base patterns. The key word must not match further left inside one more letter.
ASSIGN = (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
          r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++")
ASSIGN_KEY = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: A whole run of token characters; '=' counts only as padding at the end, so that values of names are tokens.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
MIN_LENGTH, MIN_TESTED, RATE, GRID, NOT_RANDOM = 20, 8, 0.05, 400, 0.001
#: Weight of the counted pairs against single letters, and of the prior in counted letters.
PAIRS, PRIOR = 0.75, 2000
#: English letters, by thousandths of a text.
LETTERS = {"a": 82, "b": 15, "c": 28, "d": 43, "e": 127, "f": 22, "g": 20, "h": 61, "i": 70, "j": 2, "k": 8, "l": 40, "m": 24,
           "n": 67, "o": 75, "p": 19, "q": 1, "r": 60, "s": 63, "t": 91, "u": 28, "v": 10, "w": 24, "x": 2, "y": 20, "z": 1}
#: Thousandths of digits, and of joints between words.
DIGITS, JOINTS = 30, 40
KINDS = ("assign", "access", "hex")
#: Alphabets, in the order they are tried: name, pattern of the token, characters in order.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", _DIGITS + _UPPER),
    ("lower36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _DIGITS + _LOWER),
    # random characters without a digit are random ones of the letters
    ("upper", r"^[A-Z]+$", _UPPER),
    ("lower", r"^[a-z]+$", _LOWER),
    ("letters", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", _UPPER + _LOWER),
    ("digits", r"^[0-9]+$", _DIGITS),
    ("base62", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
)


def _found(text: Column) -> dict[str, Column]:
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def within(test: Column, pattern: str) -> Column:
        return F.when(test, matches(text, pattern)).otherwise(none)

    return {
        "assign": F.filter(within(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), ASSIGN),
                           lambda x: F.length(F.regexp_replace(x["found"], ASSIGN_KEY, "")) >= 8),
        "access": F.filter(within(F.contains(text, F.lit("AKIA")), ACCESS),
                           lambda x: F.length(x["found"]) >= 16),
        "hex": within(text.rlike("[0-9a-f]{32}"), HEX),
    }


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the five-term approximation (error below 1e-7) at |z|."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _squares(place: Column) -> Column:
    """Sum of the squared counts of each character, from their sorted places."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    closed = lambda held: held["sum"] + held["run"].cast("double") * held["run"]
    return F.aggregate(F.array_sort(place), start, lambda held, v: F.struct(
        v.alias("last"), F.when(v == held["last"], held["run"] + 1).otherwise(F.lit(1)).alias("run"),
        F.when(v == held["last"], held["sum"]).otherwise(closed(held)).alias("sum")), closed)


def _in_order(place: Column, k: Column) -> Column:
    """struct<high, changes, product>: characters in the upper half of the alphabet, changes between
    halves, and the sum of products of neighbours around the mean."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("high"), F.lit(0).alias("changes"), F.lit(0.0).alias("product"))
    upper = lambda v: v * 2 >= k
    return F.aggregate(place, start, lambda held, v: F.struct(
        v.alias("last"), (held["high"] + upper(v).cast("int")).alias("high"),
        (held["changes"] + ((held["last"] >= 0) & (upper(v) != upper(held["last"]))).cast("int")).alias("changes"),
        (held["product"] + F.when(held["last"] >= 0, (v - (k - 1) / 2) * (held["last"] - (k - 1) / 2)).otherwise(F.lit(0.0))).alias("product")))


#: Symbols of the pair model: 0 to 25 letters in either case, 26 digits, 27 all else.
SYMBOLS = 28


def _symbols(text: Column) -> Column:
    """Symbols of the characters of a text."""
    return F.transform(F.filter(F.split(ascii_lower(text), ""), lambda c: c != ""), lambda c: F.when(
        F.instr(F.lit(_LOWER), c) > 0, F.instr(F.lit(_LOWER), c) - 1).otherwise(
        F.when(F.instr(F.lit(_DIGITS), c) > 0, F.lit(26)).otherwise(F.lit(27))))


def pair_counts(docs: DataFrame, text: str = "text") -> dict[tuple[int, int], int]:
    """Pairs of neighbouring symbols in the distinct words of all texts; at most SYMBOLS squared numbers.

    Words are runs of letters, digits and the joints of tokens, shorter than a candidate.
    """
    words = (docs.select(F.explode(F.split(F.col(text), "[^A-Za-z0-9+/_-]+")).alias("word"))
             .filter(F.length("word").between(2, MIN_LENGTH - 1)).distinct())
    rows = words.select(_symbols(F.col("word")).alias("s")).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.element_at("s", i) * SYMBOLS + F.element_at("s", i + 1))).alias("pair"))
    return {divmod(r.pair, SYMBOLS): r.n for r in rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}


def pair_model(counts: dict[tuple[int, int], int]) -> tuple[list[float], list[float], list[float]]:
    """Logarithms of the chance of each symbol after each, and their mean and variance by the symbol before."""
    prior = [float(LETTERS[c]) for c in _LOWER] + [float(DIGITS), float(JOINTS)]
    scale = PRIOR / sum(prior)
    single = [p * scale + sum(counts.get((a, b), 0) for a in range(SYMBOLS)) for b, p in enumerate(prior)]
    single = [x / sum(single) for x in single]
    logs, means, variances = [], [], []
    for a in range(SYMBOLS):
        after = [counts.get((a, b), 0) + 20.0 * single[b] for b in range(SYMBOLS)]
        chance = [PAIRS * x / sum(after) + (1 - PAIRS) * q for x, q in zip(after, single)]
        mean = sum(c * math.log(c) for c in chance)
        logs += [math.log(c) for c in chance]
        means.append(mean)
        variances.append(sum(c * (math.log(c) - mean) ** 2 for c in chance))
    return logs, means, variances


def ordinary(symbols: Column, model: tuple[list[float], list[float], list[float]]) -> Column:
    """P-value of a token's chance against those of ordinary tokens: small if it is no ordinary one."""
    logs, means, variances = (F.array(*[F.lit(x) for x in v]) for v in model)
    before, after = F.slice(symbols, 1, F.size(symbols) - 1), F.slice(symbols, 2, F.size(symbols) - 1)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda held, x: held + x)

    excess = total(F.zip_with(before, after, lambda a, b: F.get(logs, a * SYMBOLS + b) - F.get(means, a)))
    return upper_tail(-excess / F.sqrt(total(F.transform(before, lambda a: F.get(variances, a)))))


def tested(tokens: DataFrame, model: tuple[list[float], list[float], list[float]]) -> DataFrame:
    """Distinct tokens: token, uses, alphabet, length class, p_random and p.

    p_random is three times the smallest of the p-values of the battery, against random characters;
    p is against ordinary tokens.
    """
    core = F.regexp_replace("token", "=+$|[-_]+", "")
    kind = F.coalesce(*[F.when(F.col("core").rlike(p), F.lit(name)) for name, p, _ in ALPHABETS])
    letters = F.coalesce(*[F.when(F.col("alphabet") == name, F.lit(text)) for name, _, text in ALPHABETS])
    rows = (tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).withColumn("core", core)
            .filter(F.length("core") >= MIN_TESTED).withColumn("alphabet", kind).withColumn("letters", letters))
    core = F.col("core")
    rows = rows.withColumn("p", ordinary(_symbols(F.regexp_replace("token", "=+$", "")), model))
    rows = rows.select("token", "uses", "p", "alphabet", F.length("letters").cast("double").alias("k"), F.length(core).cast("double").alias("n"),
                       F.transform(F.filter(F.split(core, ""), lambda c: c != ""), lambda c: F.instr("letters", c) - 1).alias("place"))
    rows = rows.select("token", "uses", "p", "alphabet", "k", "n", _squares(F.col("place")).alias("squares"),
                       _in_order(F.col("place"), F.col("k")).alias("walk"))
    rows = rows.select("token", "uses", "p", "alphabet", "k", "n", (F.col("squares") * F.col("k") / F.col("n") - F.col("n")).alias("chi"),
                       F.col("walk.high").alias("high"), F.col("walk.changes").alias("changes"), F.col("walk.product").alias("product"))
    # cube-root normal form of chi-squared with k - 1 degrees of freedom: too uneven a token speaks for words
    f = 2.0 / (9.0 * (F.col("k") - 1))
    even = (F.pow(F.greatest("chi", F.lit(1e-9)) / (F.col("k") - 1), F.lit(1 / 3)) - (1 - f)) / F.sqrt(f)
    expected = 2.0 * F.col("high") * (F.col("n") - F.col("high")) / F.col("n")
    rows = rows.withColumn("even", even).withColumn("expected", expected)
    spread = F.sqrt(F.greatest(F.col("expected") * (F.col("expected") * 2 - 1) / F.greatest(F.col("n") - 1, F.lit(1.0)), F.lit(1e-9)))
    # characters of one half only: all in one run
    rows = rows.withColumn("runs", F.when(F.col("expected") == 0, F.lit(40.0)).otherwise(F.abs(F.col("changes") - F.col("expected")) / spread))
    variance = (F.col("k") * F.col("k") - 1) / 12
    rows = rows.withColumn("serial", F.abs("product") / (variance * F.sqrt(F.greatest(F.col("n") - 1, F.lit(1.0)))))
    least = F.least(upper_tail(F.col("even")), 2 * upper_tail(F.col("runs")), 2 * upper_tail(F.col("serial")))
    return rows.select("token", "uses", "p", "alphabet", F.least(F.lit(1.0), 3 * least).alias("p_random"),
                       F.floor(F.log2("n") * 2).cast("int").alias("length_class"))


def random_tokens(judged: DataFrame) -> DataFrame:
    """Tokens that the battery takes for random and that false-discovery control finds not to be ordinary."""
    judged = judged.filter(F.col("p_random") >= NOT_RANDOM)
    step = F.least(F.lit(GRID), F.floor(-F.log10(F.greatest("p", F.lit(1e-40))) * 10)).cast("int")
    rows = judged.withColumn("step", step)
    grid = rows.groupBy("alphabet", "length_class", "step").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("largest"))
    group = Window.partitionBy("alphabet", "length_class")
    below = group.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    grid = (grid.withColumn("rank", F.sum("n").over(below)).withColumn("all", F.sum("n").over(group))
            .withColumn("out", F.col("largest") <= F.col("rank") / F.col("all") * RATE))
    limits = grid.groupBy("alphabet", "length_class").agg(F.min(F.when(F.col("out"), F.col("step"))).alias("limit"))
    # at most one row per alphabet and length class, some dozens
    return (rows.join(F.broadcast(limits), ["alphabet", "length_class"])
            .filter(F.col("step") >= F.col("limit")).select("token", "uses", "alphabet", "p"))


def find(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, base spans, and spans of random tokens (kind ``random``)."""
    rows = docs.select(F.col(row_id), whole_text(text).alias("text"))
    found = _found(F.col("text"))
    base = F.concat(*[of_kind(F.col(f"found_{k}"), k) for k in KINDS])
    rows = rows.select("*", *[c.alias(f"found_{k}") for k, c in found.items()]).withColumn(
        "base", F.array_sort(base, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                             .otherwise(_order(a["kind"]) - _order(b["kind"]))))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    tokens = F.when(F.col("text").rlike(r"[A-Za-z0-9+/_-]{20}"), F.filter(
        matches(F.col("text"), TOKEN), lambda t: ~F.exists(
            "base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))).otherwise(none)
    table = written(rows.select(F.monotonically_increasing_id().alias("row"), row_id, "base", tokens.alias("tokens")))
    uses = table.select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.end", F.col("t.found").alias("token"))
    judged = written(tested(uses, pair_model(pair_counts(rows.select("text")))))
    secret = random_tokens(judged).select("token", "uses")
    extra = (with_group_values(uses, secret, "token", "uses", uses.count()).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x"))
             .select("row", F.transform("x", lambda x: F.struct(F.lit("random").alias("kind"), x["start"].alias("start"),
                                                                x["end"].alias("end"))).alias("random")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return table.join(extra, "row", "left").select(row_id, "base", F.coalesce("random", empty).alias("random"))


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, (*KINDS, "random"))), kind).cast("int")


def digest_columns(found: DataFrame, row_id: str = "doc_id") -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.array_sort(F.concat("base", "random"), lambda a, b: F.when(a["start"] < b["start"], -1).when(
        a["start"] > b["start"], 1).otherwise(_order(a["kind"]) - _order(b["kind"])))
    return found.select(row_id, *[count(k) for k in KINDS],
                        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))
