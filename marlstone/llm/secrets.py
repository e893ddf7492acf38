"""Secret scans: fixed patterns and a battery of randomness tests, in DataFrame operations only.

Candidates are runs of at least 20 characters of encoded text. Each is held against the smallest alphabet that
explains it (hexadecimal, base32, base36, base62, base64) by three tests of randomness: chi-squared uniformity of the
alphabet, runs above and below its middle, and correlation of neighbours. The worst of the three standard scores is
small for random strings of any length and grows with the length for words. False discoveries are controlled by length:
runs with letters and without digits serve as decoys for mixed runs, and in each length class the largest score stands up
to which the mixed runs that are words, as the decoys tell, are at most a given rate of all; classes with few candidates
are looked at together. Some random strings have no digit by chance, so letters that look random among letters alone are decoys
only as far as there are more of them than the mixed runs explain. Runs of digits alone are neither: they are often random
(order numbers, card-like ids) without being words, and there are no decoys to hold them against. Counts by class and score, a table of fixed size, are all that is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .apply import quoted
from .store import saved

#: Fixed patterns: kind, pattern, the group whose length counts, and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))
RANDOM = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Alphabets of encodings, the smallest first: name, pattern, symbols.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
    ("base62", "^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64", "", UPPER + LOWER + DIGITS + "+/"),
)
#: Alphabets of letters alone, as above.
LETTERS = (("^[a-z]+$", LOWER), ("^[A-Z]+$", UPPER), ("^[A-Za-z]+$", UPPER + LOWER))
#: Length classes start at these lengths; scores are counted in steps of 1/4 up to 8.
CLASSES, STEP, TOP = (20, 24, 32, 40, 64, 128), 4, 32
RATE, LIMIT = 0.05, 3.5


def _running(values: Column) -> Column:
    """The sums of an array's values up to each, by doubling: n log n steps, where appending one by one would copy n arrays."""
    rounds = F.ceil(F.log2(F.size(values).cast("double"))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), rounds - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
    once = lambda sums, w: F.transform(sums, lambda x, i: F.when(i >= w, x + F.get(sums, i - w)).otherwise(x))
    return F.when(F.size(values) <= 1, values).otherwise(F.aggregate(steps, values, once))


def _below(ascending: Column, steps: Column, limit: Column) -> Column:
    """How many of an ascending array's values are below limit, by bisection; steps are falling powers of two that sum to its size at least."""
    once = lambda n, w: F.when((n + w <= F.size(ascending)) & (F.get(ascending, n + w - 1) < limit), n + w).otherwise(n)
    return F.aggregate(steps, F.lit(0), once)


def _matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """The matches of pattern, leftmost and apart, as structs (start, kind, end, body) in code points, without those whose group is shorter than least."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # The text before each match, and the matches, make the offsets.
    pair = F.arrays_zip(whole.alias("m"), body.alias("b"), F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(whole), F.lit(0))).alias("g"))
    placed = lambda p: F.arrays_zip(p["m"].alias("m"), p["b"].alias("b"), _running(F.transform(p, lambda x: F.length(x["g"]) + F.length(x["m"]))).alias("end"))
    span = lambda x: F.struct((x["end"] - F.length(x["m"])).cast("int").alias("start"), F.lit(kind).alias("kind"), x["end"].cast("int").alias("end"), x["b"].alias("body"))
    found = let(pair, lambda p: F.transform(F.filter(placed(p), lambda x: F.length(x["b"]) >= least), span))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,body:string>>)")
    return F.when(text.rlike(pattern), found).otherwise(none)


def _alphabet(core: Column) -> tuple[Column, Column]:
    """The symbols of the encoding that explains core, and core written in them."""
    plain = F.translate(core, "-_", "+/")
    kinds = [(core.rlike(p), s, F.lower(core) if name in ("hex", "base36") else core) for name, p, s in ALPHABETS[:-1]]
    symbols = reduce(lambda rest, k: F.when(k[0], F.lit(k[1])).otherwise(rest), reversed(kinds), F.lit(ALPHABETS[-1][2]))
    return symbols, reduce(lambda rest, k: F.when(k[0], k[2]).otherwise(rest), reversed(kinds), plain)


def letter_randomness(token: Column) -> Column:
    """The same for letters alone, held against an alphabet of letters; NULL for other strings."""
    core = F.rtrim(token, F.lit("="))
    symbols = reduce(lambda rest, k: F.when(core.rlike(k[0]), F.lit(k[1])).otherwise(rest), reversed(LETTERS), F.lit(None).cast("string"))
    return let(F.struct(symbols.alias("symbols"), core.alias("core")), lambda t: F.when(t["symbols"].isNotNull(), _battery(t["symbols"], t["core"])))


def randomness(token: Column) -> Column:
    """The worst standard score of the three tests; near 0 to 3 for random strings."""
    symbols, core = _alphabet(F.rtrim(token, F.lit("=")))
    return let(F.struct(symbols.alias("symbols"), core.alias("core")), lambda t: _battery(t["symbols"], t["core"]))


def _battery(symbols: Column, core: Column) -> Column:
    n, k = F.length(core).cast("double"), F.length(symbols).cast("double")
    chars = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    squares = F.aggregate(chars(symbols), F.lit(0.0), lambda a, c: let(n - F.length(F.replace(core, c, F.lit(""))), lambda x: a + x * x))
    zero = F.struct(*(F.lit(0.0).alias(x) for x in ("first", "last", "high", "runs", "s", "ss", "lag")))

    def step(a: Column, v: Column) -> Column:
        up = v * 2 > k
        return F.struct(
            F.when(a["first"] == 0, v).otherwise(a["first"]).alias("first"),
            v.alias("last"),
            (a["high"] + F.when(up, 1.0).otherwise(0.0)).alias("high"),
            (a["runs"] + F.when((a["last"] == 0) | (up != (a["last"] * 2 > k)), 1.0).otherwise(0.0)).alias("runs"),
            (a["s"] + v).alias("s"),
            (a["ss"] + v * v).alias("ss"),
            (a["lag"] + v * a["last"]).alias("lag"),
        )

    walked = F.aggregate(F.transform(chars(core), lambda c: F.call_function("instr", symbols, c).cast("double")), zero, step)

    def worst(w: Column) -> Column:
        chi = (w["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        high, low = w["w"]["high"], n - w["w"]["high"]
        spread = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, F.abs(w["w"]["runs"] - 2 * high * low / n - 1) / F.sqrt(spread)).otherwise(F.lit(9.0))
        mean = w["w"]["s"] / n
        var = w["w"]["ss"] / n - mean * mean
        lag = w["w"]["lag"] - mean * (2 * w["w"]["s"] - w["w"]["first"] - w["w"]["last"]) + (n - 1) * mean * mean
        serial = F.when(var > 0, F.abs(lag / n / var + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        return F.greatest(chi, runs, serial)

    return let(F.struct(squares.alias("squares"), walked.alias("w")), worst)


def _text_of(spans: Column, names: list[str]) -> Column:
    table = F.array(*(F.lit(x) for x in names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(table, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, limit: float = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are kind:start:end in code points, by start and then kind. Null texts count as empty and have none; texts of
    any length are scanned whole, in time that is all but proportional to their length and matches; repeated rows are
    scanned and counted each; scores that tie at a cut are reported or left together; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    names = [b[0] for b in BASE] + ["random"]
    rows = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("t"))
    found = rows.select("doc_id", *(_matches(F.col("t"), i, p, g, n).alias(name) for i, (name, p, g, n) in enumerate(BASE)), _matches(F.col("t"), len(BASE), RANDOM, 0, 20).alias("random"))
    base = F.array_sort(F.concat(*(F.transform(F.col(b[0]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))) for b in BASE)))
    found = found.select("doc_id", *(F.size(b[0]).cast("long").alias(f"n_{b[0]}") for b in BASE), base.alias("base"), "random")
    # A span meets none of the fixed ones if as many of these end up to its start as begin before its end.
    ends = F.struct(F.transform("base", lambda b: b["start"]).alias("starts"), F.array_sort(F.transform("base", lambda b: b["end"])).alias("ends"))
    bits = F.ceil(F.log2(F.size("base") + 1.0)).cast("int")
    steps = F.when(F.size("base") > 0, F.transform(F.sequence(bits - 1, F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))).otherwise(F.array().cast("array<int>"))
    free = let(F.struct(ends.alias("e"), steps.alias("steps")), lambda z: F.filter(F.col("random"), lambda s: _below(z["e"]["starts"], z["steps"], s["end"]) == _below(z["e"]["ends"], z["steps"], s["start"] + 1)))
    size = lambda s: F.length(s["body"])
    cls = lambda s: reduce(lambda a, c: a + F.when(size(s) >= c, 1).otherwise(0), CLASSES[1:], F.lit(0))
    scored = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), cls(s).alias("cls"), F.least(F.lit(TOP), F.greatest(F.lit(0), F.floor(randomness(s["body"]) * STEP))).cast("int").alias("bin"), (s["body"].rlike("[0-9]") & s["body"].rlike("[A-Za-z]")).alias("mixed"), (~s["body"].rlike("[0-9]") & s["body"].rlike("[A-Za-z]")).alias("decoy"), F.coalesce(letter_randomness(s["body"]) < limit, F.lit(False)).alias("loose")))
    found = saved(found.select("doc_id", *(f"n_{b[0]}" for b in BASE), "base", scored.alias("random")))
    bins = found.select(F.explode("random").alias("r")).groupBy("r.cls", "r.bin").agg(F.count_if("r.mixed").alias("mixed"), F.count_if(F.expr("r.decoy and not r.loose")).alias("words"), F.count_if(F.expr("r.decoy and r.loose")).alias("loose")).collect()
    cuts = cut_scores([(r["cls"], r["bin"], r["mixed"], r["words"], r["loose"]) for r in bins], rate, limit)
    upto = F.array(*(F.lit(c) for c in cuts))
    added = F.transform(F.filter(F.col("random"), lambda s: s["mixed"] & (s["bin"] <= F.element_at(upto, s["cls"] + 1))), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", *(f"n_{b[0]}" for b in BASE), F.size(added).cast("long").alias("n_random"), F.sha2(_text_of(F.col("base"), names), 256).alias("base_sha256"), _text_of(F.array_sort(F.concat("base", added)), names).alias("spans"))


def pooled_classes(candidates: list[int], least: float) -> list[list[int]]:
    """The length classes in groups of neighbours, from the longest down, each with least candidates or more; what is left at the end joins the last group."""
    groups: list[list[int]] = [[]]
    for c in reversed(range(len(CLASSES))):
        if sum(candidates[k] for k in groups[-1]) >= least:
            groups.append([])
        groups[-1].append(c)
    if len(groups) > 1 and sum(candidates[k] for k in groups[-1]) < least:
        rest = groups.pop()
        groups[-1] += rest
    return groups


def cut_scores(bins: list[tuple[int, int, int, int, int]], rate: float = RATE, limit: float = LIMIT) -> list[int]:
    """For each length class the largest score (in steps) up to which words are at most rate of the mixed candidates; -1 where there is none. bins: class, score, mixed runs, words, and runs of letters that look random among letters.

    Mixed words are as many as decoys, and one more, times the ratio of both among what scores beyond limit (one at most). Of mixed
    runs of n characters, (52 / 62)^n more are random without any digit: so many loose runs, and two standard deviations more, are no decoys.
    """
    top = limit * STEP
    near = [sum(x[2] for x in bins if x[0] == c and x[1] < top) for c in range(len(CLASSES))]
    out = [-1] * len(CLASSES)
    for group in pooled_classes(near, 1 / rate):
        mine = sorted((x for x in bins if x[0] in group), key=lambda x: x[1])
        far = [sum(x[k] for x in mine if x[1] >= top) for k in (2, 3)]
        ratio = min(1.0, (far[0] + 1) / (far[1] + 1))
        best, mixed, words, loose, bare = -1, 0, 0, 0, 0.0
        for b in sorted({x[1] for x in mine if x[1] < top}):
            for c, at, m, w, u in mine:
                if at == b:
                    mixed, words, loose = mixed + m, words + w, loose + u
                    bare += m * (part := (52 / 62) ** CLASSES[c]) / (1 - part)
            decoys = words + max(0.0, loose - bare - 2 * bare**0.5)
            if mixed and ratio * (decoys + 1) <= rate * mixed:
                best = b
        for c in group:
            out[c] = best
    return out
