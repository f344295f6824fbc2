"""Secret scans in DataFrame functions: fixed patterns, and character Markov models that tell random strings apart.

Two first-order models, of random strings and of ordinary identifiers, are counted from labelled samples. A long token's
score is the sum over its characters of the log ratio of the two transition probabilities.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of spans in their order, the patterns of the first three, and the characters of a long token.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Shortest token that the models judge, and the log-likelihood ratio per character, in nats, from which it is random.
SHORTEST, LEAST_RATIO = 20, 0.5

#: Documents whose words are the samples of ordinary identifiers, and generated random strings.
SAMPLE_DOCS, SAMPLE_RANDOM = 2000, 3000

LONG = r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST
STEP = 128


def _free(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of the table has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _so_far(values: Column, join) -> Column:
    """What ``join`` makes of the values up to each; the state of an aggregate is copied at each step, so that this is for short arrays."""
    none = F.expr("cast(array() as array<int>)")
    add = lambda a, x: F.concat(a, F.array(join(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)), x)))
    return F.aggregate(values, none, add)


def running(items: Column, value, join) -> Column:
    """What ``join`` makes of the values, 0 at least, of the items up to each.

    It works on pieces of STEP items and then on the pieces' last values, so that many items in one text don't take quadratic
    time. The items are a column that the table holds; an expression would be computed for each piece.
    """
    n = F.size(items)
    firsts = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / STEP), F.lit(0)).cast("int"))
    inner = F.transform(firsts, lambda i: _so_far(F.transform(F.slice(items, i * STEP + 1, F.lit(STEP)), value), join))
    ends = _so_far(F.transform(inner, lambda c: F.coalesce(F.get(c, F.size(c) - 1), F.lit(0))), join)
    bases = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
    return F.flatten(F.zip_with(inner, bases, lambda c, base: F.transform(c, lambda x: join(x, base))))


def matched(df: DataFrame, text: str, out: str, kind: int, pattern: str, fits=None) -> DataFrame:
    """Adds ``out``: (start, kind, end) of the pattern's leftmost non-overlapping matches that fit.

    A match ends where the matches up to it and the pieces of text between them end. Arrays are arguments of the
    higher-order functions and never stand inside their lambdas, where they would be computed for each match.
    """
    found, sizes = _free(df, "found", "sizes")
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    df = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    between = F.zip_with(F.col(found), F.split(F.col(text), pattern, -1), lambda m, piece: F.length(m) + F.length(piece))
    df = df.withColumn(sizes, F.when(F.size(found) > 0, F.slice(between, F.lit(1), F.size(found))))
    ends = running(F.col(sizes), lambda x: x, lambda a, x: a + x)
    spans = F.zip_with(F.col(found), ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("match")))
    if fits is not None:
        spans = F.filter(spans, lambda s: fits(s["match"], s["start"], s["end"]))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return df.withColumn(out, F.when(F.size(found) > 0, spans).otherwise(none)).drop(found, sizes)


def named(spans: Column) -> Column:
    """kind:start:end of the spans in order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _signs(token: Column) -> Column:
    """The places of a token's characters in the alphabet, 0 for others; one pass over the token."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(samples: DataFrame) -> list[float]:
    """The log ratios of transitions, random over ordinary, from rows of (token, random): a row and a column per character.

    Index 0 stands for the start and for other characters. Counts get one added; samples of one label alone give ratios
    against an even model, none at all give zeros. Null tokens and labels are left out.
    """
    marked = samples.where("token is not null and random is not null and length(token) > 0")
    signs = _signs(F.col("token"))
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(signs, F.lit(1), F.size(signs) - 1)), signs, lambda a, b: a * (len(ALPHABET) + 1) + b)
    rows = marked.select("random", F.explode(pairs).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in rows.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    n = len(ALPHABET) + 1
    sums: Counter = Counter()
    for (random, pair), c in counts.items():
        sums[random, pair // n] += c
    p = lambda random, pair: (counts.get((random, pair), 0) + 1) / (sums[random, pair // n] + n)
    return [math.log(p(True, pair) / p(False, pair)) for pair in range(n * n)]


def samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labelled tokens: generated random strings in the usual encodings, and words of a bounded sample of documents, alone and joined.

    Tokens that the fixed patterns match aren't taken as ordinary. The bounds are SAMPLE_DOCS and SAMPLE_RANDOM; the documents
    are those with the least hashes of their texts, each text once, and read whole where they lie.
    """
    spark = docs.sparkSession
    key = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 512)
    coded = F.array(key, F.upper(key), *[F.regexp_replace(F.base64(F.unhex(key)), r"\s", "")] * 3, F.translate(F.regexp_replace(F.base64(F.unhex(key)), r"\s", ""), "+/", "-_"))
    random = spark.range(SAMPLE_RANDOM).select(F.substring(F.get(coded, (F.col("id") % 6).cast("int")), 1, 48).alias("token"), F.lit(True).alias("random"))
    own = docs.select(F.col(text).alias("text"), F.xxhash64(text, F.lit("secrets")).alias("spot")).where("text is not null")
    total = own.agg(F.approx_count_distinct("spot")).first()[0]
    # a few times the share that is wanted, of which the least are taken
    least = int((min(1.0, 3 * SAMPLE_DOCS / max(1, total)) * 2 - 1) * 2**63)
    last = own.where(F.col("spot") <= min(least, 2**63 - 1)).select("spot").distinct().orderBy("spot").limit(SAMPLE_DOCS).agg(F.max("spot")).first()[0]
    chosen = own.where(F.col("spot") <= (-(2**63) if last is None else last)).groupBy("spot").agg(F.first("text").alias("text"))
    listed = chosen.select(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0)).alias("words"))
    # neighbours joined as identifiers are, in turn by a dash, an underscore and nothing
    signs = F.array(*map(F.lit, ("-", "_", "")))
    joint = F.zip_with("words", F.slice("words", F.lit(2), F.size("words") + 1), lambda a, b: F.concat(a, F.get(signs, F.length(a) % 3), F.coalesce(b, a)))
    words = listed.select(F.explode(F.concat("words", joint)).alias("token"))
    ordinary = words.where(~F.col("token").rlike(f"{HEX}|{ACCESS}|(?=.*[0-9])(?=.*[A-Za-z]).{{16,}}")).select("token", F.lit(False).alias("random"))
    return random.unionByName(ordinary)


def score(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a token per character; the time is in proportion to its length."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    zero = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    add = lambda a, sign: F.struct(sign.alias("before"), (a["sum"] + F.get(table, a["before"] * (len(ALPHABET) + 1) + sign)).alias("sum"))
    return F.aggregate(_signs(token), zero, add, lambda a: a["sum"]) / F.length(token)


def scan(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (start, kind, end) in characters, by start and then kind; ends are exclusive.

    Base spans are those of the kinds assign, access and hex; ``spans`` adds the long tokens that the models
    hold for random and that no base span holds whole; they may overlap base spans. Null texts count as empty and have none, as do empty ones. Rows are
    judged one by one, whatever else they hold; the two columns take the place of any of the same name, and all others stay. Nothing is shuffled.
    """
    df = docs.drop("base", "spans")
    work, *parts = _free(df, "text_to_scan", *(f"spans_{k}" for k in range(4)))
    df = df.withColumn(work, F.coalesce(F.col(text), F.lit("")))
    df = matched(df, work, parts[0], 0, ASSIGN, lambda m, a, b: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
    df = matched(df, work, parts[1], 1, ACCESS)
    df = matched(df, work, parts[2], 2, HEX)
    df = df.withColumn("base", F.array_sort(F.concat(*parts[:3])))
    fresh = lambda a, b: ~F.exists("base", lambda s: (s["start"] <= a) & (s["end"] >= b))
    df = matched(df, work, parts[3], 3, LONG, lambda m, a, b: (score(m, ratios) >= LEAST_RATIO) & fresh(a, b))
    return df.withColumn("spans", F.array_sort(F.concat("base", parts[3]))).drop(work, *parts)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping ones, replaced by the mark; spans are in order of their starts.

    The text is cut in a form with four bytes a character, so that the time is in proportion to text and spans.
    """
    # how far the spans up to each reach, and where the text left before each begins
    reach = running(spans, lambda s: s["end"], F.greatest)
    before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(spans) - 1))
    cuts = F.zip_with(spans, before, lambda s, b: F.struct(b.alias("from"), s["start"].alias("to")))
    units = F.encode(text, "UTF-32")
    # a first character that reads as a byte order mark would go, so that a blank stands before each piece
    piece = lambda held, a, n: F.substring(F.decode(F.concat(F.unhex(F.lit("00000020")), F.substring(held, 4 * a + 1, 4 * n)), "UTF-32"), F.lit(2), n)
    parts = F.zip_with(F.array_repeat(units, F.size(spans)), cuts, lambda held, c: F.when(c["to"] >= c["from"], F.concat(piece(held, c["from"], c["to"] - c["from"]), F.lit(mark))).otherwise(F.lit("")))
    last = F.element_at(reach, -1)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), piece(units, last, F.length(text) - last)))


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, n_assign, n_access, n_hex, base_sha256 and the spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(key, *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
