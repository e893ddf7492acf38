"""Duplicates and entity resolution: blocked candidates, scores, classes that fail closed, and assignment."""

from __future__ import annotations

import difflib
import functools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.arrays import let
from ..session import shipped
from ..sources.stage import saved


def duplicate_audit(df: DataFrame, definitions: dict[str, list[str]], id_col: str) -> DataFrame:
    """Rows that share a key, for each definition: definition, id, group_size, occurrence (in order of id). NULL keys are no duplicates."""
    out = None
    for name, keys in definitions.items():
        by = Window.partitionBy(*keys)
        rows = df.filter(sum((F.when(F.col(k).isNull(), 1).otherwise(0) for k in keys), F.lit(0)) == 0)
        rows = rows.select(F.lit(name).alias("definition"), id_col, F.count(F.lit(1)).over(by).alias("group_size"), F.row_number().over(by.orderBy(id_col)).alias("occurrence")).filter("group_size > 1")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Names in a block of one length band; a task compares two blocks at a time.
BLOCK, CELLS = 2000, 64


def _compared(floor: float):
    """Of a tile's names of each side: the pairs whose sequence ratio is floor or more."""

    def letters(names: list[str]) -> np.ndarray:
        """How many characters of each name fall in each of CELLS cells; two names share no more than the sum of the smaller counts."""
        code = np.array([ord(c) % CELLS for n in names for c in n], np.int64)
        row = np.repeat(np.arange(len(names)), [len(n) for n in names])
        return np.bincount(row * CELLS + code, minlength=len(names) * CELLS).reshape(-1, CELLS).astype(np.uint16)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (t.column("name").to_pylist() for t in (left, right))
        out: list[tuple[str, str, float]] = []
        if a and b:
            x, n = letters(a), np.array([len(s) for s in a])
            match = difflib.SequenceMatcher(None)
            for name, counts in zip(b, letters(b), strict=True):
                near = np.flatnonzero(2 * np.minimum(x, counts).sum(1) >= (floor - 1e-9) * (n + len(name)))
                if len(near):
                    match.set_seq2(name)
                    for i in near:
                        match.set_seq1(a[i])
                        # The same bound without cells, then the ratio itself.
                        if match.quick_ratio() >= floor and (ratio := match.ratio()) >= floor:
                            out.append((a[i], name, ratio))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["left", "right", "ratio"])

    return run


def alike_names(left: DataFrame, right: DataFrame, floor: float, block: int = BLOCK) -> DataFrame:
    """(left, right, ratio) of all distinct names (name) of two tables whose sequence ratio is floor or more; no such pair is left out.

    Every block of names of one table meets every block of the other whose lengths allow the floor: a ratio of t over m
    and n characters matches t (m + n) / 2 of them, so the shorter name has t / (2 - t) of the longer one's length.
    Within a tile of at most block names a side, letter counts bound the ratio before it is computed. Empty names have no partner.
    """
    shipped(left.sparkSession)
    sides = []
    for df in (left, right):
        names = df.select("name").filter(F.length("name") > 0).distinct().withColumn("n", F.length("name"))
        count = names.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        sides.append((names.join(count, "n").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")), count))
    grid = [c.select(F.col("n").alias(f"n_{x}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{x}"), F.lit(1).alias("one")) for (_, c), x in zip(sides, "lr", strict=True)]
    long, short = F.greatest("n_l", "n_r"), F.least("n_l", "n_r")
    tiles = grid[0].join(grid[1], "one").filter(short * (2 - floor) >= (floor - 1e-9) * long)
    dealt = []
    for (names, _), x in zip(sides, "lr", strict=True):
        at = tiles.select(F.col(f"n_{x}").alias("n"), F.col(f"part_{x}").alias("part"), F.concat_ws(":", "n_l", "part_l", "n_r", "part_r").alias("tile"))
        dealt.append(names.join(at, ["n", "part"]).select("tile", "name"))
    return dealt[0].groupBy("tile").cogroup(dealt[1].groupBy("tile")).applyInArrow(_compared(floor), "left string, right string, ratio double")


def candidates(left: DataFrame, right: DataFrame, floor: float = 0.55, drop: Sequence[str] = ()) -> DataFrame:
    """Pairs of (id, name, phone, area) tables with an equal phone or core name, or names alike by floor or more, in full or in their cores without the words of drop; name_similarity is the larger of both ratios. Names that several rows have are compared once; all their rows are paired."""
    shipped(left.sparkSession)
    sides = [df.select("id", T.folded(F.col("name")).alias("full"), T.core_name(F.col("name"), drop).alias("core"), T.phone_key(F.col("phone")).alias("phone"), "area") for df in (left, right)]
    sides = [df.select(*(F.col(c).alias(f"{c}_{x}") for c in df.columns)) for df, x in zip(sides, "lr", strict=True)]

    def equal(c: str) -> DataFrame:
        return sides[0].join(sides[1], F.col(f"{c}_l") == F.col(f"{c}_r")).select("id_l", "id_r", F.lit(None).cast("double").alias("ratio"))

    def alike(c: str) -> DataFrame:
        names = alike_names(*(df.select(F.col(f"{c}_{x}").alias("name")) for df, x in zip(sides, "lr", strict=True)), floor)
        one = names.join(sides[0].select("id_l", F.col(f"{c}_l").alias("left")), "left")
        return one.join(sides[1].select("id_r", F.col(f"{c}_r").alias("right")), "right").select("id_l", "id_r", "ratio")

    pairs = equal("phone").unionByName(equal("core")).unionByName(alike("full"))
    if drop:
        pairs = pairs.unionByName(alike("core"))
    pairs = pairs.groupBy("id_l", "id_r").agg(F.max("ratio").alias("name_similarity"))
    for df, x in zip(sides, "lr", strict=True):
        pairs = pairs.join(df, f"id_{x}")
    # Neither name is alike by floor: the ratios of those that only a phone or a core name brings together are taken here.
    ratio = T.sequence_ratio("full_l", "full_r")
    rest = pairs.filter(F.col("name_similarity").isNull()).withColumn("name_similarity", F.greatest(ratio, T.sequence_ratio("core_l", "core_r")) if drop else ratio)
    return pairs.filter(F.col("name_similarity").isNotNull()).unionByName(rest)


def _order() -> Column:
    """What the best of scored pairs is the largest of."""
    return F.struct(F.coalesce(F.col("phone_l") == F.col("phone_r"), F.lit(False)).alias("p"), "score", "name_similarity", (-F.col("id_r")).alias("i"))


def _or_unmatched(df: DataFrame) -> DataFrame:
    return df.select("id_l", "id_r", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("status", F.lit("UNMATCHED")).alias("status"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def best_matches(left: DataFrame, scored: DataFrame) -> DataFrame:
    """One row for each row of left (id): its best of scored (id_l, id_r, score, name_similarity, status and others) by equal phone, score and name; those without any are UNMATCHED at a score of 0."""
    best = scored.groupBy("id_l").agg(F.max_by(F.struct("id_r", "score", "status"), _order()).alias("x"), F.count(F.lit(1)).alias("n_candidates")).select("id_l", "x.*", "n_candidates")
    return _or_unmatched(left.select(F.col("id").alias("id_l")).join(best, "id_l", "left"))


def best_of_candidates(left: DataFrame, right: DataFrame, scored: Callable[[DataFrame], DataFrame], floor: float = 0.55, drop: Sequence[str] = ()) -> DataFrame:
    """best_matches(left, scored(candidates(left, right, floor, drop))), without a row for each pair of rows.

    Rows that are equal in all that a score may read are one class, with its least id and its number of rows. scored adds
    score and status from name_similarity, phone_l, phone_r, area_l and area_r; phones are NULL where they are not equal.
    Candidates by name are taken for each name and area, those by phone for each row that has any: these go first.
    """
    shipped(left.sparkSession)
    sides = []
    for df, x in ((left, "l"), (right, "r")):
        side = df.select("id", F.coalesce(T.folded(F.col("name")), F.lit("")).alias("full"), T.core_name(F.col("name"), drop).alias("core"), T.phone_key(F.col("phone")).alias("phone"), "area")
        sides.append(saved(side.select(*(F.col(c).alias(f"{c}_{x}") for c in side.columns))))
    one, two = sides
    words = [df.select(f"full_{x}", f"core_{x}").distinct() for df, x in zip(sides, "lr", strict=True)]

    def alike(c: str) -> DataFrame:
        names = alike_names(*(df.select(F.col(f"{c}_{x}").alias("name")) for df, x in zip(sides, "lr", strict=True)), floor).withColumnsRenamed({"left": f"{c}_l", "right": f"{c}_r"})
        return (names if c == "full" else names.join(words[0], "core_l").join(words[1], "core_r")).select("full_l", "full_r", "ratio")

    pairs = words[0].join(words[1], F.col("core_l") == F.col("core_r")).select("full_l", "full_r", F.lit(None).cast("double").alias("ratio")).unionByName(alike("full"))
    if drop:
        pairs = pairs.unionByName(alike("core"))
    named = saved(pairs.groupBy("full_l", "full_r").agg(F.max("ratio").alias("ratio")))
    # Pairs of rows with an equal phone, by classes, and how alike their names are.
    class_r = two.groupBy("full_r", "phone_r", "area_r").agg(F.min("id_r").alias("id_r"), F.count(F.lit(1)).alias("n"))
    class_l = one.filter("phone_l IS NOT NULL").select("full_l", "phone_l", "area_l").distinct()
    called = saved(class_l.join(class_r, F.col("phone_l") == F.col("phone_r")))
    met = called.select("full_l", "full_r").distinct().withColumn("called", F.lit(True))
    both = named.withColumn("named", F.lit(True)).join(met, ["full_l", "full_r"], "full")
    full = T.sequence_ratio("full_l", "full_r")
    cores = [w.groupBy(f"full_{x}").agg(F.min(f"core_{x}").alias(f"core_{x}")) for w, x in zip(words, "lr", strict=True)]
    rest = both.filter("ratio IS NULL").join(cores[0], "full_l").join(cores[1], "full_r")
    rest = rest.withColumn("ratio", F.greatest(full, T.sequence_ratio("core_l", "core_r")) if drop else full).select(*both.columns)
    alike_by = saved(both.filter("ratio IS NOT NULL").unionByName(rest).withColumnRenamed("ratio", "name_similarity"))

    def best(of: DataFrame, keys: list[str], n: Column) -> DataFrame:
        out = scored(of).groupBy(*keys).agg(F.max_by(F.struct("id_r", "score", "status"), _order()).alias("x"), F.sum(n).alias("n"))
        return out.select(*(F.col(k).alias(f"{k}_k") for k in keys), "x", "n")

    by_phone = best(called.join(alike_by.filter("called"), ["full_l", "full_r"]), ["full_l", "phone_l", "area_l"], F.when(F.col("named"), 0).otherwise(F.col("n")))
    areas_l, areas_r = one.select("full_l", "area_l").distinct(), two.groupBy("full_r", "area_r").agg(F.min("id_r").alias("id_r"), F.count(F.lit(1)).alias("n"))
    no = F.lit(None).cast("string")
    by_name = best(alike_by.filter("named").join(areas_l, "full_l").join(areas_r, "full_r").withColumns({"phone_l": no, "phone_r": no}), ["full_l", "area_l"], F.col("n"))
    same = lambda *keys: functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_k")) for k in keys))
    out = one.join(by_phone.withColumnsRenamed({"x": "x_phone", "n": "n_phone"}), same("full_l", "phone_l", "area_l"), "left").drop("full_l_k", "area_l_k")
    out = out.join(by_name, same("full_l", "area_l"), "left").withColumn("x", F.coalesce("x_phone", "x"))
    count = F.coalesce("n", F.lit(0)) + F.coalesce("n_phone", F.lit(0))
    return _or_unmatched(out.select("id_l", "x.*", count.alias("n_candidates")))


def match_score(name: Column, phone: Column, area: Column, address: Column) -> Column:
    """0.60 name, 0.20 phone, 0.15 area (missing: half), 0.05 address; an equal phone lifts the score to 0.95."""
    flag = lambda c: c.cast("double")
    raw = 0.60 * name + 0.20 * F.coalesce(flag(phone), F.lit(0.0)) + 0.15 * F.coalesce(flag(area), F.lit(0.5)) + 0.05 * F.coalesce(address, F.lit(0.0))
    return F.bround(F.least(F.lit(1.0), F.greatest(raw, F.when(phone, 0.95).otherwise(0.0))), 4)


def match_class(score: Column, name: Column, phone: Column, area: Column) -> Column:
    """Contradictions and unknown areas go to review, never to an automatic match."""
    return F.when(F.coalesce(phone, F.lit(False)), "HIGH_CONFIDENCE").when((name >= 0.95) & F.coalesce(area, F.lit(False)), "HIGH_CONFIDENCE").when(score >= 0.55, "REVIEW_REQUIRED").otherwise("UNMATCHED")


def assigned_once(matches: DataFrame, owner: str, score: str, tie: str) -> DataFrame:
    """Of several rows that claim one owner the best keeps its class; the others go to review."""
    best = F.row_number().over(Window.partitionBy(owner).orderBy(F.col(score).desc(), F.col(tie)))
    return matches.withColumn("status", F.when((F.col("status") == "HIGH_CONFIDENCE") & (best > 1), "REVIEW_REQUIRED").otherwise(F.col("status")))


def alignment_label(a: dict[str, Column], b: dict[str, Column], has_a: Column, has_b: Column) -> Column:
    """How two sources speak of an aspect. a (reviews): mention in per cent, support, low and high shares of its mentions in per cent; b (complaints): mention in per cent, small (few documents). has_a, has_b: whether the aspect exists in each source at all.

    Mentioned is 15 % with five documents in support, a concern 50 % of these low, a strength 70 % high; a theme of
    complaints is 25 % of enough documents.
    """
    know_a, know_b = a["mention"].isNotNull(), b["mention"].isNotNull()
    sure_a, sure_b = know_a & (a["support"] >= 5), know_b & ~F.coalesce(b["small"], F.lit(True))
    yes = lambda c: F.coalesce(c, F.lit(False))
    mentioned, theme = yes(sure_a & (a["mention"] >= 15)), yes(sure_b & (b["mention"] >= 25))
    concern, strength = mentioned & yes(a["low"] >= 50), mentioned & yes(a["high"] >= 70)
    return (
        F.when(has_a & ~has_b, F.when(mentioned, "REVIEWS_ONLY").otherwise("NO_SIGNAL"))
        .when(has_b & ~has_a, F.when(theme, "COMPLAINTS_ONLY").otherwise("NO_SIGNAL"))
        .when((know_a & ~yes(sure_a)) | (know_b & ~yes(sure_b)), "LOW_SUPPORT")
        .when(concern & theme, "BOTH_CONCERN")
        .when(strength & theme, "STRENGTH_VS_COMPLAINT")
        .when(theme & ~mentioned, "COMPLAINTS_ONLY")
        .when(mentioned & ~theme, "REVIEWS_ONLY")
        .otherwise("NO_SIGNAL")
    )


def brand_words(name: Column, generic: Sequence[str]) -> Column:
    """The distinct words of a name that are not generic, in order."""
    words = F.filter(F.split(F.coalesce(T.folded(name), F.lit("")), " "), lambda w: (w != "") & ~w.isin(*generic))
    return F.array_distinct(words)


def validation_terms(pages: DataFrame, generic: Sequence[str], floor: float = 0.75) -> DataFrame:
    """For rows (id, name, url) of entities and the page each is found on: wanted, excluded and doubtful terms, and whether documents of the page need them.

    Wanted are the name and its core, excluded the names of others on the page, doubtful a first brand word that other
    words follow. A page is trusted if it is one entity's and its last part is like the name by floor. A page lists few
    entities; their names are one array.
    """
    shipped(pages.sparkSession)
    on_page = pages.groupBy("url").agg(F.sort_array(F.collect_set(F.struct("id", "name"))).alias("__all"))
    slug = F.translate(F.regexp_extract(F.regexp_replace("url", "/+$", ""), "([^/]*)$", 1), "-", " ")
    core = lambda c: T.core_name(c, generic)
    rows = pages.join(on_page, "url").withColumns({"__core": core(F.col("name")), "__slug": core(slug), "__brand": brand_words(F.col("name"), generic)})
    others = F.array_distinct(F.transform(F.filter("__all", lambda x: x["id"] != F.col("id")), lambda x: x["name"]))
    trusted = (F.size(others) == 0) & (T.sequence_ratio("__core", "__slug") >= floor)
    return rows.select("id", "name", "url", F.array_distinct(F.array("name", F.coalesce("__core", "name"))).alias("wanted"), others.alias("excluded"), F.when(F.size("__brand") >= 2, F.slice("__brand", 1, 1)).otherwise(F.array().cast("array<string>")).alias("doubtful"), (~trusted).alias("requires_validation"))


def entity_match(document: Column, requires: Column, wanted: Column, excluded: Column, doubtful: Column) -> Column:
    """Whether a document is about an entity, as struct (status, term): an excluded term goes before a wanted one, that before a doubtful one; the first of each kind is the evidence."""
    first = lambda terms, text: F.get(F.filter(terms, lambda t: F.contains(text, T.match_key(t))), F.lit(0))

    def judged(text: Column) -> Column:
        hits = F.struct(first(excluded, text).alias("x"), first(wanted, text).alias("w"), first(doubtful, text).alias("d"))
        status = lambda h: F.when(h["x"].isNotNull(), "EXCLUDED").when(h["w"].isNotNull(), "MATCHED").otherwise("REVIEW_REQUIRED")
        return let(hits, lambda h: F.struct(status(h).alias("status"), F.coalesce(h["x"], h["w"], h["d"]).alias("term")))

    return F.when(~requires, F.struct(F.lit("MATCHED").alias("status"), F.lit(None).cast("string").alias("term"))).otherwise(let(T.match_key(document), judged))


def resolved_by_source(docs: DataFrame, rules: DataFrame, id_col: str, source: str, text: Column) -> DataFrame:
    """(id, entity, pattern, status) of documents by rules (source, priority, pattern, entity), each of which holds for one source alone: the entity of the first rule, by priority, whose pattern the text has.

    RESOLVED, NO_RULE_HOLDS, or NO_RULES where the document's source is missing or has none; never a guess from another source's rules.
    A source has few rules: they are one array, looked through in order of priority (ties by pattern). A missing text has no pattern.
    """
    mine = rules.groupBy(F.col("source").alias("__source")).agg(F.array_sort(F.collect_list(F.struct("priority", "pattern", "entity"))).alias("__rules"))
    rows = docs.select(id_col, F.col(source).alias("__source"), text.alias("__text")).join(mine, "__source", "left")
    first = F.get(F.filter("__rules", lambda r: F.regexp_like(F.col("__text"), r["pattern"])), F.lit(0))
    rows = rows.select(id_col, F.col("__rules").isNotNull().alias("__has"), first.alias("__first"))
    status = F.when(~F.col("__has"), "NO_RULES").when(F.col("__first").isNull(), "NO_RULE_HOLDS").otherwise("RESOLVED")
    return rows.select(id_col, F.col("__first.entity").alias("entity"), F.col("__first.pattern").alias("pattern"), status.alias("status"))


def unique_only(df: DataFrame, key: str, out: str) -> DataFrame:
    """out is key where no other row has it, else NULL: a shared key proves nothing."""
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(Window.partitionBy(key)) == 1, F.col(key)))


def candidate_score(name: Column, area: Column, contact: Column) -> Column:
    """0.70 name and 0.15 for an equal area and for an equal contact."""
    return 0.70 * name + 0.15 * area.cast("int") + 0.15 * contact.cast("int")


def classified_candidates(df: DataFrame, owner: str, score: str, tie: str, exact: Column, conflict: Column) -> DataFrame:
    """Each owner's best candidate with its gap to the runner-up and its class; a conflict or a close runner-up is never accepted."""
    by = Window.partitionBy(owner).orderBy(F.col(score).desc(), F.col(tie))
    best = df.withColumns({"gap": F.col(score) - F.lead(score).over(by), "__rn": F.row_number().over(by), "__exact": exact, "__conflict": conflict}).filter("__rn = 1")
    s = F.col(score)
    label = F.when(F.col("__conflict"), "REVIEW_CONFLICT").when(F.col("gap") < 0.05, "AMBIGUOUS").when(F.col("__exact") & (s >= 0.90), "EXACT").when(s >= 0.75, "ACCEPTED").when(s >= 0.45, "REVIEW").otherwise("NONE")
    return best.withColumn("status", label).drop("__rn", "__exact", "__conflict")


def identity_status(bound: Column, name: Column) -> Column:
    """A page bound to the entity's id needs a name similarity of 0.84, any other 0.92."""
    return F.when(bound & (name >= 0.84), "VERIFIED_BY_ID").when(name >= 0.92, "VERIFIED_BY_NAME").otherwise("NOT_VERIFIED")


def suggestion(similarity: Column) -> Column:
    return F.when(similarity >= 0.90, "merge after a look").when(similarity >= 0.75, "compare contact data").when(similarity >= 0.55, "look again later").otherwise("leave apart")
