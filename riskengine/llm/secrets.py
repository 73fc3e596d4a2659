"""Secret scans: fixed patterns, and a battery of randomness tests over key-like tokens,
in DataFrame functions only.

*Patterns* (kinds ``assign``, ``access``, ``hex``): leftmost non-overlapping matches of the
whole text. Positions come from splitting the text at the same matches and summing
lengths, in code points.

*Battery* (kind ``random``). Candidates are runs of ``MIN_TOKEN`` or more characters of the
base64 alphabets. Each gets the smallest alphabet that holds it: hex (either case, also in
groups joined by -), base32 or base36 (letters of one case and digits) or base64; of a token
that ends in ``_`` and a run of base36, as prefixed keys do, that run is tested. Words are
candidates like any other and are left to the tests. Under the hypothesis that its symbols are
uniform and independent, three p-values are computed: chi-squared uniformity of the
alphabet (Wilson-Hilferty), the number of runs above and below the alphabet's middle, and
the lag-1 serial correlation; three times the smallest (Bonferroni) is the token's.
Tokens that the battery rejects are ordinary text. The rejections are controlled per
stratum of encoding and length (powers of two) by Benjamini and Hochberg's procedure at
``FALSE_RATE``, so short tokens, on which the tests have little power, do not spend the
allowance of long ones, and of the tokens let go at most that share is expected to be
random. What is not rejected is reported. The procedure needs p-values of the whole corpus:
they are counted per stratum in ``BINS`` steps of a tenth of a decade, and only the
strata's thresholds (one number each) come to the driver.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned
row by row; an empty table gives an empty result; clashing input columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskengine.llm.common import fresh, with_result

# The patterns of the contract. A run of 14 or 16 that is matched greedily
# is the same span as a longer or shorter run filtered by length afterwards; an assignment
# is filtered afterwards, since a short one uses up its text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN = 20
TOKEN = "[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN
HEX_SYMBOLS = "0123456789abcdef"
BASE32_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36_SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE64_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
FALSE_RATE = 0.05
BINS = 200
MASK = "[SECRET]"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _no_spans(kind: str = "array<struct<start:bigint,end:bigint>>") -> Column:
    return F.array().cast(kind)


def match_spans(text: Column, pattern: str) -> Column:
    """[start, end) of every match, in code points; one test decides texts without any."""
    def place(state, pair):
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        return F.struct(end.cast("long").alias("at"), F.concat(state["out"], F.array(
            F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))).alias("out"))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), matches,
                       lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    found = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), _no_spans().alias("out")), place,
                        lambda state: state["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(_no_spans())


def assign_spans(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    both = F.zip_with(match_spans(text, ASSIGN), values, lambda s, v: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), (F.length(v) >= ASSIGN_VALUE).alias("ok")))
    kept = F.transform(F.filter(both, lambda s: s["ok"]), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.regexp_like(text, F.lit(ASSIGN)), kept).otherwise(_no_spans())


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution (a five-term polynomial, 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(symbols: Column, alphabet: Column) -> Column:
    """Three times the smallest p-value of the three tests (1 at most). ``symbols``:
    numbers from 0, as doubles; ``alphabet``: how many there are."""
    n = F.size(symbols).cast("double")
    k = alphabet.cast("double")
    pairs_same = F.aggregate(F.array_distinct(symbols), F.lit(0.0), lambda acc, s: acc + F.pow(
        F.size(F.filter(symbols, lambda v: v == s)).cast("double"), F.lit(2.0)))
    chi = k / n * pairs_same - n
    spread = 2 / (9 * (k - 1))
    p_chi = normal_tail((F.pow(F.greatest(chi / (k - 1), F.lit(0.0)), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
    high = F.transform(symbols, lambda v: F.when(v >= k / 2, 1.0).otherwise(0.0))
    here = F.slice(symbols, 2, F.size(symbols))
    highs = F.aggregate(high, F.lit(0.0), lambda a, v: a + v)
    lows = n - highs
    turns = F.aggregate(F.zip_with(F.slice(high, 2, F.size(high)), F.slice(high, 1, F.size(high) - 1),
                                   lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v)
    mean_runs = 2 * highs * lows / n + 1
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    p_runs = F.when(var_runs > 0, 2 * normal_tail(F.abs(turns + 1 - mean_runs) / F.sqrt(var_runs))).otherwise(0.0)

    # The mean is computed once, not per symbol.
    def serial(mean):
        var = F.aggregate(symbols, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        cov = F.aggregate(F.zip_with(here, F.slice(symbols, 1, F.size(symbols) - 1),
                                     lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, v: a + v)
        return F.when(var > 0, 2 * normal_tail(F.abs(cov / var + 1 / n) * F.sqrt(n))).otherwise(0.0)

    p_serial = _let(F.aggregate(symbols, F.lit(0.0), lambda a, v: a + v) / n, serial)
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def tested_part(token: Column) -> Column:
    """The key of a prefixed token, or the whole token."""
    key = F.regexp_extract(token, "_([a-z0-9]{%d,}|[A-Z0-9]{%d,})$" % (MIN_TOKEN, MIN_TOKEN), 1)
    return F.when(key != "", key).otherwise(token)


def inferred(token: Column) -> Column:
    """The smallest encoding that holds a token. Letters alone are base36: few keys are base32
    without a digit, and the wider alphabet tells words better from keys."""
    return (F.when(F.regexp_like(token, F.lit("^[0-9A-Fa-f]+$|^[0-9A-Fa-f]{4,}(-[0-9A-Fa-f]{4,})+$")), "hex")
            .when(F.regexp_like(token, F.lit("^(?=.*[2-7])([A-Z2-7]+|[a-z2-7]+)$")), "base32")
            .when(F.regexp_like(token, F.lit("^([a-z0-9]+|[A-Z0-9]+)$")), "base36").otherwise("base64"))


def candidates(text: Column) -> Column:
    """array<struct<start, end, stratum, bin>> of the tokens. bin: the
    battery's p-value in tenths of decades, 0 for p near 1."""
    def tested(s):
        token = F.substring(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        return _let(tested_part(token), lambda tok: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), inferred(tok).alias("encoding"), tok.alias("token")))

    def scored(c):
        enc = c["encoding"]
        alphabet = (F.when(enc == "hex", HEX_SYMBOLS).when(enc == "base32", BASE32_SYMBOLS)
                    .when(enc == "base36", BASE36_SYMBOLS).otherwise(BASE64_SYMBOLS))
        flat = (F.when(enc == "hex", F.lower(F.translate(c["token"], "-", ""))).when(enc == "base32", F.upper(c["token"]))
                .when(enc == "base36", F.lower(c["token"])).otherwise(F.translate(c["token"], "-_", "+/")))
        symbols = F.transform(F.split(flat, ""), lambda x: (F.instr(alphabet, x) - 1).cast("double"))
        p = _let(symbols, lambda v: battery(v, F.length(alphabet)))
        tenths = F.least(F.lit(BINS - 1), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-30)))))
        stratum = F.concat(enc, F.lit(":"), F.floor(F.log2(F.length(c["token"]).cast("double"))).cast("string"))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), stratum.alias("stratum"),
                        F.greatest(F.lit(0), tenths).cast("int").alias("bin"))

    kind = "array<struct<start:bigint,end:bigint,stratum:string,bin:int>>"
    spans = F.transform(match_spans(text, TOKEN), tested)
    return F.when(F.regexp_like(text, F.lit(TOKEN)), F.transform(spans, scored)).otherwise(_no_spans(kind))


def thresholds(docs: DataFrame, text: Column, false_rate: float = FALSE_RATE) -> dict[str, int]:
    """For each stratum the lowest bin that Benjamini and Hochberg's procedure rejects."""
    tokens = docs.select(F.explode(candidates(text)).alias("c"))
    counts = tokens.groupBy("c.stratum", "c.bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy("stratum")
    worse = F.sum("n").over(own.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    tested = counts.withColumn("m", F.sum("n").over(own)).withColumn("at_least", worse)
    passing = tested.where(F.col("m") * F.pow(F.lit(10.0), -F.col("bin") / 10) <= false_rate * F.col("at_least"))
    return {r["stratum"]: r["b"] for r in passing.groupBy("stratum").agg(F.min("bin").alias("b")).collect()}


def _named(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, text: str = "text", false_rate: float = FALSE_RATE) -> DataFrame:
    """``docs`` with base_spans and spans: array<struct<start, rank, end, kind>>, sorted; spans
    adds the random tokens that base spans do not cover fully."""
    body = F.coalesce(F.col(text), F.lit(""))
    limits = thresholds(docs, body, false_rate)
    limit_of = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else None
    names = {c: fresh(docs, f"scan_{c}") for c in ("base", "tokens")}
    base = F.sort_array(F.concat(_named(assign_spans(body), "assign"), _named(match_spans(body, ACCESS), "access"),
                                 _named(match_spans(body, HEX), "hex")))
    found = docs.withColumn(names["base"], base).withColumn(names["tokens"], candidates(body))

    def secret(c):
        limit = F.element_at(limit_of, c["stratum"]) if limit_of is not None else F.lit(None).cast("int")
        covered = F.aggregate(F.col(names["base"]), c["start"], lambda at, b: F.when(
            b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))
        return (limit.isNull() | (c["bin"] < limit)) & (covered < c["end"])

    random = _named(F.filter(names["tokens"], secret), "random")
    return with_result(found, base_spans=F.col(names["base"]),
                       spans=F.sort_array(F.concat(F.col(names["base"]), random))).drop(*names.values())


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``'s rows."""
    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", count("assign"), count("access"), count("hex"),
                          F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mask``; n_chars, if
    there, follows. No row is dropped."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("body"))
    out = scan(carried, "body")

    def cut(state, s):
        start = F.greatest(s["start"], state["at"])
        gap = F.substring("body", state["at"].cast("int") + 1, (start - state["at"]).cast("int"))
        # A span that begins inside the one before it is already masked.
        own = F.when((s["start"] >= state["at"]), mask).otherwise("")
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"),
                        F.concat(state["out"], F.array(F.concat(gap, own))).alias("out"))

    pieces = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), _no_spans("array<string>").alias("out")), cut)
    clean = _let(pieces, lambda p: F.concat(F.array_join(p["out"], ""), F.substr("body", p["at"].cast("int") + 1)))
    out = out.select("row", F.when(F.size("spans") > 0, clean).alias("clean"))
    columns = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == text:
            value = F.coalesce("clean", value)
        elif c == "n_chars":
            value = F.coalesce(F.length("clean").cast(docs.schema[c].dataType), value)
        columns.append(value.alias(c))
    return out.select(*columns)
