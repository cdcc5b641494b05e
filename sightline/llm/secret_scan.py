"""Secret scans, as DataFrame expressions alone.

Base kinds are patterns: assign (a name such as password, then a value), access
(access key ids) and hex (long hexadecimal runs). Beside them, a battery of
randomness tests looks at every other long token: for the encoding inferred
from its characters (decimal, hexadecimal, base 32, base 64), chi-squared uniformity over
the alphabet, a runs test and a lag-1 serial correlation. A token that any test
rejects as random is text. For the rest, the chi-squared statistic gives the
chance that text, whose letters are uneven, looks so even at this length; a
Benjamini-Hochberg threshold over all tokens of the corpus in each band of
lengths controls the share of false discoveries. The bands make it aware of
length: a short token must look far more even, as text often does by chance.

The thresholds need one number for each of a few length bands (at most 32 rows
reach the driver). There is no shuffle but that count.

Offsets are in code points, ends exclusive. Defined cases: a null or empty text
has no spans; a very long text is one row like any other, its matches placed in
blocks; spans of equal start are in the order of KINDS; equal rows give equal rows; an empty table gives no thresholds and
no rows; other columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base patterns.
NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""(?i:({NAMES}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # 18 characters or more
HEX = "[0-9a-f]{16,}"
#: Tokens that the randomness tests look at.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]

#: Tests reject at so many standard deviations; share of false discoveries; unevenness (expected chi-squared a character) of what is no secret, by alphabet size. Digits alone are often even, so they never count as evidence.
REJECT, FALSE_SHARE, UNEVEN = 3.0, 0.01, {10: 0.0, 16: 2.0, 32: 2.5, 64: 3.0}
_ALPHABETS = {10: "0123456789", 16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


#: Matches that are placed together; blocks of them are then shifted, so that a text of many matches is not copied for each.
BLOCK = 256


def _spans(text: Column, pattern: str, gate: Column) -> Column:
    """start, end, token of each match, leftmost first; the text between matches gives the offsets."""
    at = F.lit(pattern)
    tokens, between = F.regexp_extract_all(text, at, F.lit(0)), F.split(text, pattern, -1)
    # the last piece between matches has no match after it
    pairs = F.filter(F.zip_with(tokens, between, lambda t, b: F.struct(F.char_length(b).alias("gap"), t.alias("token"))), lambda p: p["token"].isNotNull())
    none = F.array().cast("array<struct<start: int, end: int, token: string>>")
    length = lambda p: p["gap"] + F.char_length(p["token"])
    step = lambda acc, p: F.struct(
        (acc["at"] + length(p)).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + length(p)).alias("end"), p["token"].alias("token")))).alias("out"),
    )
    placed = lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), step)
    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: placed(F.slice(p, k * BLOCK + 1, F.lit(BLOCK))))
    shifted = lambda acc, b: F.struct(
        (acc["at"] + b["at"]).alias("at"),
        F.concat(acc["out"], F.array(F.transform(b["out"], lambda s: F.struct((acc["at"] + s["start"]).alias("start"), (acc["at"] + s["end"]).alias("end"), s["token"].alias("token"))))).alias("out"),
    )
    nested = F.array().cast("array<array<struct<start: int, end: int, token: string>>>")
    # in an array of one, so that the pattern runs once
    all_ = F.transform(F.array(pairs), lambda p: F.when(F.size(p) == 0, none).otherwise(F.flatten(F.aggregate(blocks(p), F.struct(F.lit(0).alias("at"), nested.alias("out")), shifted, lambda acc: acc["out"]))))[0]
    return F.when(gate, all_).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, for z >= 0: exact at 0 and in the limit, within 2 % between."""
    return F.sqrt(F.lit(2 / 3.141592653589793)) * F.exp(-z * z / 2) / (z + F.sqrt(z * z + 8 / 3.141592653589793))


def _tests(token: Column) -> Column:
    """size, chi, runs, serial and evidence (tenths of -log10 of the chance of so even a text) of a token."""
    body = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    size = F.when(body.rlike("^[0-9]+$"), 10).when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(body.rlike("^[A-Z2-7]+$"), 32).otherwise(64)
    alphabet = F.when(size == 10, _ALPHABETS[10]).when(size == 16, _ALPHABETS[16]).when(size == 32, _ALPHABETS[32]).otherwise(_ALPHABETS[64])
    chars = F.split(F.when(size == 16, F.lower(body)).otherwise(body), "")
    start = F.struct(size.alias("size"), F.transform(chars, lambda c: F.instr(alphabet, c) - 1).alias("x"))
    return F.transform(F.array(start), lambda s: _measured(s["size"], s["x"]))[0]


def _measured(size: Column, x: Column) -> Column:
    n, k = F.greatest(F.size(x), F.lit(1)).cast("double"), size.cast("double")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b.cast("double"))
    chi = total(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))) * k / n - n
    high = total(F.transform(x, lambda v: F.when(v * 2 >= size, 1).otherwise(0)))
    low = n - high
    next_ = F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))
    runs = 1.0 + total(F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), next_, lambda a, b: F.when((a * 2 >= size) != (b * 2 >= size), 1).otherwise(0)))
    expected = 2.0 * high * low / n + 1.0
    spread = (expected - 1.0) * (expected - 2.0) / F.greatest(n - 1.0, F.lit(1.0))
    runs_z = F.when(spread > 0, (runs - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(99.0)
    mean = total(x) / n
    around = F.transform(x, lambda v: v - mean)
    variance = total(F.transform(around, lambda v: v * v))
    lagged = total(F.zip_with(F.slice(around, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(around, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a * b))
    serial = F.when(variance > 0, lagged / F.greatest(variance, F.lit(1e-9)) * F.sqrt(n)).otherwise(99.0)
    chi_z = (chi - (k - 1)) / F.sqrt(F.greatest(2 * (k - 1) * (n - 1) / n, F.lit(1e-9)))
    uneven = F.when(size == 10, UNEVEN[10]).when(size == 16, UNEVEN[16]).when(size == 32, UNEVEN[32]).otherwise(UNEVEN[64])
    z = (k - 1 + n * uneven - chi) / F.sqrt(2 * (k - 1) + 4 * n * uneven)
    evidence = F.when(z > 0, F.floor(-10 * F.log10(F.greatest(_normal_tail(z), F.lit(1e-30))))).otherwise(0)
    return F.struct(
        F.floor(F.log2(n)).cast("int").alias("band"),
        F.when((chi_z < REJECT) & (F.abs(runs_z) < REJECT) & (F.abs(serial) < REJECT), evidence).otherwise(0).cast("int").alias("evidence"),
    )


def _tokens(text: Column) -> Column:
    """start, end and tests (band, evidence) of each long token."""
    found = _spans(text, TOKEN, text.rlike(TOKEN))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _tests(s["token"]).alias("t")))


def thresholds(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """Least evidence for a discovery in each length band: Benjamini-Hochberg over all long tokens of docs, counted by evidence first."""
    each = docs.select(F.explode(_tokens(F.coalesce(F.col(text), F.lit("")))).alias("s"))
    counts = each.groupBy(F.col("s.t.band").alias("band"), F.col("s.t.evidence").alias("evidence")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc("evidence"))
    ranked = counts.withColumn("above", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("band")))
    passing = ranked.where((F.col("evidence") > 0) & (F.col("m") * F.pow(F.lit(10.0), -F.col("evidence") / 10.0) <= FALSE_SHARE * F.col("above")))
    return dict(map(tuple, passing.groupBy("band").agg(F.min("evidence")).collect()))


def scan(docs: DataFrame, least: dict[int, int], text: str = "text", battery: str | None = None) -> DataFrame:
    """docs with one more column, secrets: kind, start, end of each span, by start and then kind as in KINDS. Random tokens that overlap a base span are left out.

    With battery, a column of that name tells what the tests found: tokens tested,
    tokens that passed as random, and those of them that lie in base spans.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    kind = lambda k, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("order"), s["end"].alias("end")))
    assign = F.filter(_spans(body, ASSIGN, named), lambda s: F.char_length(F.regexp_extract(s["token"], ASSIGN, 2)) >= ASSIGN_LEAST)
    base = F.concat(kind("assign", assign), kind("access", _spans(body, ACCESS, body.contains("AKIA"))), kind("hex", _spans(body, HEX, body.rlike(HEX))))
    out = docs.withColumn("_base", base)
    if least or battery:
        bound = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else F.create_map().cast("map<int, int>")
        random = lambda s: (s["t"]["evidence"] > 0) & (s["t"]["evidence"] >= F.coalesce(F.try_element_at(bound, s["t"]["band"]), F.lit(1 << 30)))
        named_ = lambda s: F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        out = out.withColumn("_all", _tokens(body)).withColumn("_more", F.filter("_all", random))
        if battery:
            out = out.withColumn(battery, F.struct(F.size("_all").cast("long").alias("tested"), F.size("_more").cast("long").alias("passed"), F.size(F.filter("_more", named_)).cast("long").alias("named")))
        out = out.withColumn("secrets", F.array_sort(F.concat("_base", kind("random", F.filter("_more", lambda s: ~named_(s)))))).drop("_base", "_all", "_more")
    else:
        out = out.withColumn("secrets", F.array_sort("_base")).drop("_base")
    names = F.array(*map(F.lit, KINDS))
    return out.withColumn("secrets", F.transform("secrets", lambda s: F.struct(names[s["order"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def digest(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or overlapping spans together, replaced by a mark."""
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
        F.struct(s["end"].alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))).alias("out"))
    )
    last = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.lit((1 << 31) - 1)))), "")
    return F.when(F.size(secrets) == 0, text).otherwise(F.aggregate(secrets, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, last))
