"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Texts become their lower-cased words; words of the benchmark are numbered, and each window of an item is a pattern of
numbers. One scan of a text's numbers yields the ends of all windows in it, which are word numbers, and those map back
to offsets of the original text. The benchmark is the stated query set. Up to BLOCK_BYTES of it are sent to the
executors at once, of which each worker builds one automaton; documents are scanned where they lie and nothing is
shuffled. A larger benchmark is read in blocks of that size: driver and workers hold one at a time, documents are
scanned once a block, what is found is written, and the documents meet their findings at the end.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .apply import annotated, arrow_type, gathered, quoted, trimmed, whole_row
from .store import dropped, saved, shipped

WINDOW = 10
#: Bytes of benchmark text in one automaton. Each word is the end of a window of ten numbers, so an automaton takes some 100 times the memory of its text.
BLOCK_BYTES = 2 << 20
#: Every byte that is no part of a word becomes a blank, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
LOWER = {b: b + 32 for b in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

Items = list[tuple[str, str | None]]


def folded(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Scanner:
    """The automaton of items (id, text): the numbers of their words, from 1, and the windows over these; a window's value is its length and the ids that hold it."""

    def __init__(self, items: Items, width: int = WINDOW):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        held: dict[tuple[int, ...], tuple[int, set[str]]] = {}
        for key, text in items:
            words = tuple(self.number.setdefault(w, len(self.number) + 1) for w in folded(text))
            for i in range(max(1, len(words) - width + 1) if words else 0):
                w = words[i : i + width]
                held.setdefault(w, (len(w), set()))[1].add(key)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, value in held.items():
            self.automaton.add_word(window, value)
        self.automaton.make_automaton()
        self.empty = not held

    def scan(self, text: str | None) -> tuple[int, list[list[int]], set[str]]:
        """Words of text, the hit ones as ranges of word numbers (end exclusive, merged), and the ids of the items that occur."""
        words, items, found = folded(text), set(), []
        if self.empty:
            return len(words), [], items
        number = self.number.get
        for end, (n, keys) in self.automaton.iter(tuple(number(w, 0) for w in words)):
            found.append((end + 1 - n, end + 1))
            items |= keys
        return len(words), merged(found), items


def merged(ranges: list) -> list[list[int]]:
    """The union of ranges (end exclusive) as apart ranges in order; touching ones are one."""
    out: list[list[int]] = []
    for start, stop in sorted(map(tuple, ranges)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def spans(text: str, ranges: list[list[int]]) -> list[list[int]]:
    """The code points of the original text that ranges of words cover, end exclusive."""
    found = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    return [[found[a][0], found[b - 1][1]] for a, b in ranges]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[Items]:
    """The query set in blocks of at most limit bytes, one item at least; a partition at a time reaches the driver."""
    block, size = [], 0
    for key, text, n in _items(benchmark).distinct().toLocalIterator():
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += n
    if block:
        yield block


def _items(benchmark: DataFrame) -> DataFrame:
    """(id, text, n): the items that have a text, and how many bytes they take."""
    key = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    return benchmark.filter(F.length("text") > 0).select(key.alias("id"), "text", (F.octet_length(key) + F.octet_length("text")).cast("long").alias("n"))


def _sized(benchmark: DataFrame) -> int:
    return _items(benchmark).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>, items array<string>"


def _columns(rows: list[tuple[int, list, list, list]]) -> list:
    """The columns FIELDS of rows of number of words, merged ranges, spans and sorted items."""
    out: list[list] = [[] for _ in range(7)]
    for n, ranges, where, keys in rows:
        for column, value in zip(out, (n, sum(b - a for a, b in ranges), len(keys), hashlib.sha256(",".join(keys).encode()).hexdigest(), bool(ranges), where, keys), strict=True):
            column.append(value)
    return out


def _scanner(docs: DataFrame, items: Items, width: int) -> Callable[[], Scanner]:
    sent, token = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    return lambda: _scanner_of(token, sent, width)


#: The last automaton that this process built, which the next task that it runs can use.
_built: list = ["", None]


def _scanner_of(token: str, sent, width: int) -> Scanner:
    if _built[0] != token:
        _built[:] = ["", None]
        _built[:] = [token, Scanner(sent.value, width)]
    return _built[1]


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, width: int, limit: int) -> DataFrame:
    """(loc, same, ranges, spans, items): the findings in each distinct text that has any, from all blocks. A text travels as two hashes."""
    rows = docs.select(quoted(text_col).alias("text")).select("text", *_hashes(F.col("text")))
    parts = []
    for block in _blocks(benchmark, limit):
        scanner = _scanner(docs, block, width)

        def make(scanner=scanner):
            one = scanner()

            def work(text, loc, same):
                out: dict = {"loc": [], "same": [], "ranges": [], "items": []}
                for t, *key in zip(text.to_pylist(), loc.to_pylist(), same.to_pylist(), strict=True):
                    _, ranges, items = one.scan(t)
                    if ranges:
                        for name, value in zip(out, (*key, ranges, sorted(items)), strict=True):
                            out[name].append(value)
                return out

            return work

        parts.append(saved(gathered(rows, "text", ["loc", "same"], "loc long, same long, ranges array<array<long>>, items array<string>", make).dropDuplicates(["loc", "same"])))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    out = saved(found.groupBy("loc", "same").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    dropped(*parts)
    return out


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("loc"), F.xxhash64(F.lit(1), text).alias("same")]


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns keep of each document, and n_words, n_hit, n_items, items_sha256, contaminated, spans (offsets of hit passages in the original text), items.

    Null and empty texts have no words, items without words no windows; null item ids read as the empty string and
    repeated items count once; repeated rows are scanned each; texts of any length are scanned whole. Windows that
    overlap or touch make one passage. An empty table gives an empty result, an empty benchmark leaves all documents
    clean. A kept column that is named like a new one gives way to it; other columns are ignored.
    """
    if _sized(benchmark) <= block_bytes:
        scanner = _scanner(docs, [x for b in _blocks(benchmark, block_bytes) for x in b], width)

        def make():
            one = scanner()

            def work(texts: pa.Array) -> list:
                rows = []
                for text in texts.to_pylist():
                    n, ranges, items = one.scan(text)
                    rows.append((n, ranges, spans(text, ranges) if ranges else [], sorted(items)))
                return _columns(rows)

            return work

        return annotated(docs, text_col, list(keep), FIELDS, make)

    def make_joined():
        def work(texts: pa.Array) -> list:
            rows = []
            for x in texts.to_pylist():
                ranges = merged(x["ranges"] or [])
                rows.append((len(folded(x["text"])), ranges, spans(x["text"], ranges) if ranges else [], x["items"] or []))
            return _columns(rows)

        return work

    found = _found(docs, benchmark, text_col, width, block_bytes)
    names = [c for c in keep if c.lower() not in {f.split()[0] for f in FIELDS.split(", ")}]
    rows = docs.select(F.struct(*(quoted(c).alias(f"k{i}") for i, c in enumerate(names)), F.lit(0).alias("k")).alias("kept"), quoted(text_col).alias("text"))
    rows = rows.select("kept", "text", *_hashes(F.col("text"))).join(found, ["loc", "same"], "left")
    out = _over_structs(rows.select("kept", F.struct("text", "ranges", "items").alias("x")), make_joined)
    return out.select(*(F.col(f"kept.k{i}").alias(c) for i, c in enumerate(names)), *(f.split()[0] for f in FIELDS.split(", ")))


def _over_structs(rows: DataFrame, make) -> DataFrame:
    """kept and FIELDS of rows (kept, x), 1000 at a time."""
    new = T.StructType.fromDDL(FIELDS)
    schema = T.StructType([rows.schema["kept"], *new])

    def run(batches):
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, arrow_type(f.dataType)) for v, f in zip(work(part.column(1)), new, strict=True))], schema.names)
            trimmed()

    shipped(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in whose texts no window occurs, in their own columns, whatever their names. See contamination."""
    rows = docs.select(whole_row(docs), quoted(text_col).alias("text"))
    if _sized(benchmark) > block_bytes:
        found = _found(docs, benchmark, text_col, width, block_bytes).select("loc", "same")
        return rows.select("row", *_hashes(F.col("text"))).join(found, ["loc", "same"], "left_anti").select("row.*")
    scanner = _scanner(docs, [x for b in _blocks(benchmark, block_bytes) for x in b], width)

    def make():
        one = scanner()
        return lambda texts: [np.array([bool(one.scan(t)[1]) for t in texts.to_pylist()], bool)]

    return annotated(rows, "text", ["row"], "hit boolean", make).filter("not hit").select("row.*")
