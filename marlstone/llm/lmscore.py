"""Language-model scoring by a weighted backoff automaton.

Training counts every n-gram of the corpus up to ORDER; those that occur twice, whatever the size of the corpus, are
kept as arcs: an arc carries the absolute-discounted, interpolated log-probability of its word after its state, and a
state's failure arc leads to the longest shorter context with the mass that its arcs leave. Below all lies the add-half
unigram distribution over the whole vocabulary and one unknown token, so every state's distribution sums to one.

Documents are dealt in blocks, n-grams in parts by context. A block sends the parts its distinct n-grams, and is sent how
often these are kept and what the kept ones of each context take, in the whole corpus. From that it builds its part of
the automaton: the states and arcs that its own texts can reach. There is one such part for a small table and many for
a large one.

By the automaton a text is scored in one left-to-right traversal, for many texts at once: a lane carries its state, follows the arc of
the next token or falls along failure arcs until there is one, and adds up what it passes. Long texts are cut in
lanes that first read the last tokens before the cut, which determine the state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .apply import annotated, arrow_type, gathered, trimmed
from .store import dropped, saved, shipped
from .toxicity import fold
from .words import END, buffers, coarse_order, combine, distinct, word_table
from .words import batches as word_batches

ORDER, DISCOUNT = 3, 0.75
#: Relative frequencies from which tokens, and longer n-grams, enter the model; both occur twice at least, which is all that is asked by default.
LEAST = (0.0, 0.0)
#: The word before a text's first, and the relative frequency from which contexts of such words are dealt by n-gram.
START, HOT = np.uint64(0xA4093822299F31D0), 2e-3
FOLDS, HELD = 5, 1
#: A block's n-grams take some twenty times the memory of its text.
BLOCK_BYTES, LANE = 8 << 20, 512
#: Bytes of text that a task deals to blocks at once.
PIECES = 32 << 20


@dataclass
class Automaton:
    """State 0 is the root, 1 to n the states of n tokens, n + 1 the start of a text, then those of longer n-grams. Arcs: sorted keys state * (n + 1) + token, log10 weights, next states. fall and loss: the failure arc of each state. falls: how many failure arcs were followed."""

    n: int
    order: int
    keys: np.ndarray
    weight: np.ndarray
    follow: np.ndarray
    fall: np.ndarray
    loss: np.ndarray
    falls: int = 0

    def step(self, state: np.ndarray, token: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log10 probability of each lane's next token (-1: one that has no state), low being that at the root, and the state after it."""
        gain, after = np.zeros(len(state)), token + 1
        open_ = np.arange(len(state))
        state = state.copy()
        while len(open_):
            s = state[open_]
            at_root = s == 0
            gain[open_[at_root]] += low[open_[at_root]]
            open_, s = open_[~at_root], s[~at_root]
            if not len(open_):
                break
            found = index_of(self.keys, s * (self.n + 1) + token[open_])
            hit = (found >= 0) & (token[open_] >= 0)
            gain[open_[hit]] += self.weight[found[hit]]
            after[open_[hit]] = self.follow[found[hit]]
            open_, s = open_[~hit], s[~hit]
            gain[open_] += self.loss[s]
            state[open_] = self.fall[s]
            self.falls += len(open_)
        return gain, after


def index_of(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' tokens, each text closed by END, and the offsets of the texts."""
    return tokens_in(*buffers(text))


def tokens_in(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tokens_of the texts that lie in data between ends."""
    hashes, size = word_table(data, ends)
    ends = np.cumsum(size)
    return np.insert(hashes, ends, END), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def traverse(model: Automaton, token: np.ndarray, offsets: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The log10 probability of each text, of whose tokens low is that at the root."""
    size, back = np.diff(offsets), model.order - 1
    parts = -(-size // LANE)
    text = np.repeat(np.arange(len(size)), parts)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[text] + piece * LANE
    end = np.minimum(begin + LANE, offsets[text + 1])
    begin_read = np.maximum(begin - back, offsets[text])
    order = np.argsort(begin_read - end, kind="stable")
    text, begin, end, at = text[order], begin[order], end[order], begin_read[order]
    state = np.where(at == offsets[text], model.n + 1, 0)
    out = np.zeros(len(size))
    live = len(at)
    for t in range(int((end - at).max()) if live else 0):
        live = int(np.searchsorted(at[:live] - end[:live] + t, 0))
        place = at[:live] + t
        gain, state[:live] = model.step(state[:live], token[place], low[place])
        counted = place >= begin[:live]
        out += np.bincount(text[:live][counted], gain[counted], len(size))
    return out


@dataclass
class Answer:
    """What a block is told of order k: the tokens that end an n-gram (at), the n-gram of each (place), how often n-grams are kept (count), and what the kept ones of each one's context take (spent)."""

    at: np.ndarray
    place: np.ndarray
    count: np.ndarray
    spent: np.ndarray | None = None


def block_automaton(offsets: np.ndarray, answers: list[Answer], total: int, kinds: int) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """The states and arcs that the texts between offsets can reach, by the answers of orders 1, 2, ...; then the number of each token, and its log10 probability at the root."""
    one, order = answers[0], len(answers)
    n, token = len(one.count), one.place
    found = one.count[token]
    begins = np.zeros(len(token), bool)
    begins[offsets[:-1]] = True
    low = (found + 0.5) / (total + 0.5 * (kinds + 1))
    # Of each token: its probability by the orders so far, the state that it leads to, and that before it with its occurrences.
    chance, state = low.copy(), token + 1
    before, often = np.roll(state, 1), np.roll(found, 1)
    before[begins], often[begins] = n + 1, found[offsets[1:] - 1]
    fall, loss = [np.zeros(n + 2, np.int64)], np.zeros(n + 2)
    keys, weight, follow = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
    for k, answer in enumerate(answers[1:], 2):
        p = np.empty(len(answer.count), np.int64)
        p[answer.place] = answer.at
        many = np.maximum(often[p], 1)
        left = np.clip(1 - answer.spent / many, 1e-12, 1.0)
        loss[before[p]] = np.log10(left)
        kept = answer.count > 0
        q = p[kept]
        keys.append(before[q] * (n + 1) + token[q])
        weight.append(np.log10((answer.count[kept] - DISCOUNT) / many[kept] + left[kept] * chance[q]))
        new = len(loss) + np.arange(len(q))
        follow.append(new if k < order else state[q])
        if k == order:
            break
        fall.append(state[q])
        loss = np.append(loss, np.zeros(len(q)))
        chance[answer.at] = np.maximum(answer.count[answer.place] - DISCOUNT, 0) / np.maximum(often[answer.at], 1) + left[answer.place] * chance[answer.at]
        longer = np.zeros(len(answer.count), np.int64)
        longer[kept] = new
        state, found = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64)
        state[answer.at], found[answer.at] = longer[answer.place], answer.count[answer.place]
        before, often = np.roll(state, 1), np.roll(found, 1)
        before[begins] = 0
    every = np.concatenate(keys)
    by = np.argsort(every)
    model = Automaton(n, order, every[by], np.concatenate(weight)[by], np.concatenate(follow)[by], np.concatenate(fall), loss)
    return model, token, np.log10(low)


def count_tokens(train: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs."""

    def make():
        def work(text):
            h, c = np.unique(tokens_of(text)[0], return_counts=True)
            return {"h": h.view(np.int64), "c": c}

        return work

    return gathered(train, "text", [], "h long, c long", make).groupBy("h").agg(F.sum("c").alias("c"))


FIELDS = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, order: int = ORDER, least: tuple[float, float] = LEAST) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text has one token, its end; texts of any length are counted and scored whole. Rows without an id are
    trained on. Repeated rows count and are scored each. Equal texts get equal scores, and there are no ties to break.
    Without training texts every probability is one. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    held = fold(F.col("doc_id"), FOLDS) == HELD
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    counts = saved(count_tokens(rows.filter(~F.col("held_out")).select("text")))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    return _by_blocks(rows, counts, total, kinds, order, least)


def _chains(hashes: np.ndarray, offsets: np.ndarray, order: int, among: list[np.ndarray | None]):
    """For each order: the context and n-gram that end at each token, where there is one, and for each sorted table of among whether it has all words of the context (START counts as one) and of the n-gram."""
    begins = np.zeros(len(hashes), bool)
    begins[offsets[:-1]] = True
    has = [np.ones(len(hashes), bool) if t is None else index_of(t, hashes) >= 0 for t in among]
    gram, valid, whole = hashes, np.ones(len(hashes), bool), has
    yield hashes, hashes, valid, [(h, h) for h in has]
    for k in range(2, order + 1):
        ctx, inner = np.roll(gram, 1), [np.roll(w, 1) for w in whole]
        if k == 2:
            ctx[begins] = START
            inner = [w | begins for w in inner]
        else:
            valid = np.roll(valid, 1) & ~begins
        gram, whole = combine(ctx, hashes), [w & h for w, h in zip(inner, has, strict=True)]
        yield ctx, gram, valid, list(zip(inner, whole, strict=True))


@dataclass
class Request:
    """The distinct n-grams of a block, by part and context: keys, training counts, parts; where runs of one context begin, their contexts and whether these are hot; at: the tokens that end an n-gram, place: the n-gram of each."""

    keys: np.ndarray
    count: np.ndarray
    part: np.ndarray
    run: np.ndarray
    ctx: np.ndarray
    hot: np.ndarray
    at: np.ndarray
    place: np.ndarray


def _request(k: int, chain: tuple, found: np.ndarray | None, weight: np.ndarray, parts: int) -> Request:
    """The Request of order k. From order 3, found has how often the n-grams of order k - 1 are kept: without a kept context nothing is asked, and n-grams without a kept end, which can't be kept, are asked as one for each context (named like it), for its weight alone; all of these travel as 0, which packs well.

    It depends on the block's texts, not on their order, so that answers can be laid beside it.
    """
    ctx, gram, valid, ((salted, _), (_, whole)) = chain
    if k > 1:
        weight = weight & whole
    if k > 2:
        valid = valid & (np.roll(found, 1) > 0)
        gram, weight = np.where(found > 0, gram, ctx), weight & (found > 0)
    at = np.flatnonzero(valid)
    keys, first, place = distinct(gram[at])
    count = np.bincount(place, weight[at], len(keys)).astype(np.int64)
    own, salted = ctx[at][first], salted[at][first] & (k > 1)
    part = (np.where(salted, keys, own) % np.uint64(parts)).astype(np.int64)
    bits = np.uint64(max(1, (parts - 1).bit_length()))
    # Contexts that share these bits may lie mixed: then a context has several runs, whose sums are added.
    by, _ = coarse_order((part.astype(np.uint64) << (np.uint64(64) - bits)) | (own >> bits))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    own, part = own[by], part[by]
    new = np.ones(len(by), bool)
    new[1:] = (own[1:] != own[:-1]) | (part[1:] != part[:-1])
    run = np.flatnonzero(new)
    return Request(keys[by], count[by], part, run, own[run], salted[by][run], at, rank[place])


def _packed(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0)).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _unpacked_all(columns: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([_unpacked(x, m) for x, m in zip(columns, sizes, strict=True)] or [np.zeros(0, np.int64)])


#: Names travel as their upper 48 bits. Beside the number of their part, of some million n-grams whatever the size of the corpus, that tells them apart but for one in 10^8.
NAME = ~np.uint64(0xFFFF)


def _cut(names: np.ndarray) -> bytes:
    return np.ascontiguousarray(names).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _whole(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


ASKED = "part int, k int, block int, n long, keys binary, counts binary, ctx binary, sizes binary, hot binary"
TOLD = "block int, k int, part int, n long, counts binary, runs long, sums binary, kinds binary"


def _in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (doc_id, held_out, text) as pieces of blocks (block, ids, held, times, sizes, data), dealt by hash of id and text.

    A task joins what it has of a block in one piece with its texts compressed, and rows equal in all in one with their
    number, so a row that is repeated very often is a few rows of its block.
    """
    kind = rows.schema["doc_id"].dataType
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType().add("block", T.IntegerType()).add("ids", T.ArrayType(kind)).add("held", T.ArrayType(T.BooleanType())).add("times", T.ArrayType(T.IntegerType())).add("sizes", T.ArrayType(T.IntegerType())).add("data", T.BinaryType())
    arrow = [arrow_type(f.dataType) for f in schema]

    def pack(batches):
        for batch in batches:
            for at, end in word_batches(batch.column(3), PIECES):
                part = pa.Table.from_batches([batch.slice(at, end - at)]).group_by(batch.schema.names).aggregate([([], "count_all")]).sort_by("block").combine_chunks()
                block = part.column("block").to_numpy()
                data, offsets = buffers(part.column("text"))
                cut = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).astype(np.int32)
                lists = lambda c, t: pa.ListArray.from_arrays(pa.array(cut), c.combine_chunks().cast(t) if isinstance(c, pa.ChunkedArray) else pa.array(c, t))  # noqa: B023, E731
                columns = [lists(c, t.value_type) for c, t in zip((part.column("doc_id"), part.column("held_out"), part.column("count_all"), np.diff(offsets)), arrow[1:5], strict=True)]
                packed = [pa.compress(data[offsets[i] : offsets[j]].tobytes(), "zstd", asbytes=True) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]], pa.int32()), *columns, pa.array(packed, pa.binary())], schema.names)
            trimmed()

    shipped(rows.sparkSession)
    return dealt.mapInArrow(pack, schema)


def _opened(pieces: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a block's rows, whether they are held out and how often they are there; then the bytes of all texts and their offsets."""
    flat = lambda c: pa.concat_arrays([x.flatten() for x in pieces.column(c).chunks])
    sizes = [sum(x) for x in pieces.column("sizes").to_pylist()]
    data = b"".join(pa.decompress(x.as_buffer(), n, "zstd", asbytes=True) if n else b"" for x, n in zip(pieces.column("data"), sizes, strict=True))
    offsets = np.concatenate([[0], np.cumsum(flat("sizes").to_numpy(zero_copy_only=False).astype(np.int64))])
    return flat("ids"), flat("held").to_numpy(zero_copy_only=False), flat("times").to_numpy(zero_copy_only=False), np.frombuffer(data, np.uint8), offsets


def _by_blocks(rows: DataFrame, counts: DataFrame, total: int, kinds: int, order: int, least: tuple[float, float]) -> DataFrame:
    """Texts are dealt in blocks of about BLOCK_BYTES, n-grams in as many parts by context.

    Each block sends each part its distinct n-grams with their counts in training texts; the part sums them, and sends
    back the counts of those that are kept, and what the kept ones of each context take. Contexts of HOT words only are
    few, but can have very many n-grams: these are dealt by themselves, and their contexts' sums are broadcast. Orders 1
    and 2 are asked together, each longer one when the answers of the one before are there.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // BLOCK_BYTES))
    blocks = _in_blocks(rows, parts)
    floor, word_floor = max(2, least[1] * total), max(2, least[0] * total)

    def words_from(least_count):
        return np.array(sorted(int(r["h"]) & (2**64 - 1) for r in counts.filter(F.col("c") >= least_count).select("h").collect()), np.uint64)

    # Words of n-grams that are frequent enough are themselves, unless more is asked of words.
    sent = spark.sparkContext.broadcast((words_from(max(2, HOT * total)), words_from(word_floor) if word_floor > floor else None))
    dropped(counts)

    def work(left: pa.Table, right: pa.Table | None, done: int, upto: int, names: np.ndarray, taken: np.ndarray):
        """The Requests of orders above done to upto, and the columns of the scores by orders up to done, whose answers right has."""
        ids, held, times, data, ends = _opened(left)
        hashes, offsets = tokens_in(data, ends)
        weight = np.repeat(np.where(held, 0, times), np.diff(offsets))
        asked, answers, found = [], [], None
        if right is not None:
            right = right.sort_by([("k", "ascending"), ("part", "ascending")])
            ks = right.column("k").to_numpy()
        for k, chain in enumerate(_chains(hashes, offsets, upto, list(sent.value)), 1):
            r = _request(k, chain, found, weight, parts)
            if k > done:
                asked.append((k, r))
                continue
            mine = right.filter(pa.array(ks == k))
            c = _unpacked_all(mine.column("counts").to_pylist(), mine.column("n").to_pylist())
            found = np.zeros(len(hashes), np.int64)
            found[r.at] = c[r.place]
            spent = None
            if k > 1:
                spent = np.add(*(_unpacked_all(mine.column(name).to_pylist(), mine.column("runs").to_pylist()) * times for name, times in (("sums", 1.0), ("kinds", -DISCOUNT))))
                spent[r.hot] = taken[index_of(names, r.ctx[r.hot] & NAME)]
                spent = np.repeat(spent, np.diff(np.append(r.run, len(r.keys))))
            if done == upto:
                answers.append(Answer(r.at, r.place, c, spent))
        if done < upto:
            return asked, []
        row, n = np.repeat(np.arange(len(ids)), np.diff(offsets)), len(ids)
        sums = lambda v: np.bincount(row, v, n)
        each = np.repeat(np.arange(n), times)
        known = sums(answers[0].count[answers[0].place] > 0).astype(np.int64)
        del hashes, weight, found, chain, r
        model, token, low = block_automaton(offsets, answers, total, kinds)
        del answers
        columns = [np.diff(offsets), known, np.full(n, total, np.int64), sums(low), traverse(model, token, offsets, low)]
        return [], [ids.take(pa.array(each)), held[each], *(c[each] for c in columns)]

    def asks(left: pa.Table, right: pa.Table | None, done: int, upto: int, hot) -> pa.Table:
        out = []
        block = left.column("block")[0].as_py()
        for k, r in work(left, right, done, upto, *hot.value)[0]:
            if not len(r.keys):
                continue
            cut = np.flatnonzero(np.diff(r.part, prepend=-1))
            runs = np.searchsorted(r.run, np.append(cut, len(r.keys)))
            sizes = np.diff(np.append(r.run, len(r.keys)))
            keys = np.where(r.keys == np.repeat(r.ctx, sizes), np.uint64(0), r.keys) if k > 2 else r.keys
            for i, (a, b) in enumerate(zip(cut, np.append(cut[1:], len(r.keys)), strict=True)):
                u, v = runs[i], runs[i + 1]
                out.append((int(r.part[a]), k, block, int(b - a), _cut(keys[a:b]), _packed(r.count[a:b]), _cut(r.ctx[u:v]), _packed(sizes[u:v]), r.hot[u:v].tobytes()))
        trimmed()
        return _rows(out, ASKED)

    def first_asks(upto: int, hot):
        return lambda left: asks(left, None, 0, upto, hot)

    def next_asks(done: int, upto: int, hot):
        return lambda left, right: asks(left, right, done, upto, hot)

    def answer(table: pa.Table) -> pa.Table:
        part, k = table.column("part")[0].as_py(), table.column("k")[0].as_py()
        joined = lambda name: b"".join(table.column(name).to_pylist())
        n = table.column("n").to_numpy()
        runs = np.array([len(x) for x in table.column("hot").to_pylist()])
        count = _unpacked_all(table.column("counts").to_pylist(), n)
        sizes = _unpacked_all(table.column("sizes").to_pylist(), runs)
        own, ctx = _whole(joined("keys")), _whole(joined("ctx"))
        if k > 2:  # what is asked for its context alone is named like it
            own = np.where(own == 0, np.repeat(ctx, sizes), own)
        keys, first, place = distinct(own)
        c = np.bincount(place, count, len(keys)).astype(np.int64)
        ctx, at, run = distinct(ctx)
        if k > 1:
            c[c < floor] = 0
        each = np.repeat(run, sizes)[first]
        sums, many = (np.bincount(each, v * (k > 1), len(ctx)).astype(np.int64) for v in (c, c > 0))
        hot = np.frombuffer(joined("hot"), bool)[at]
        a, u = np.cumsum(n) - n, np.cumsum(runs) - runs
        out = [(b, k, part, int(m), _packed(c[place[i : i + m]]), int(w), _packed(sums[run[j : j + w]]), _packed(many[run[j : j + w]])) for b, m, w, i, j in zip(table.column("block").to_pylist(), n, runs, a, u, strict=True)]
        return _rows([*out, (-1, k, part, int(hot.sum()), ctx[hot].tobytes(), int(hot.sum()), _packed(sums[hot]), _packed(many[hot]))], TOLD)

    told, sums, done = None, {}, 0

    def hot_sums():
        names = np.array(sorted(sums), np.uint64)
        return spark.sparkContext.broadcast((names, np.array([sums[int(h)] for h in names], np.float64)))

    for upto in range(min(2, order), order + 1):
        hot = hot_sums()
        if told is None:
            asked = blocks.groupBy("block").applyInArrow(first_asks(upto, hot), ASKED)
        else:
            asked = blocks.groupBy("block").cogroup(told.filter("block >= 0").groupBy("block")).applyInArrow(next_asks(done, upto, hot), ASKED)
        new = saved(asked.groupBy("part", "k").applyInArrow(answer, TOLD))
        for r in new.filter("block = -1 and n > 0").toLocalIterator():
            n = r["n"]
            for h, x, m in zip(np.frombuffer(r["counts"], np.uint64).tolist(), _unpacked(r["sums"], n).tolist(), _unpacked(r["kinds"], n).tolist(), strict=True):
                sums[h] = sums.get(h, 0.0) + x - DISCOUNT * m
        told, done = new if told is None else told.unionByName(new), upto
        # What was shuffled for this round isn't read again; Spark deletes it when the plan is collected.
        del asked
        spark.sparkContext._jvm.System.gc()
    hot = hot_sums()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right, order, order, *hot.value)[1]
        trimmed()
        return pa.table(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return blocks.groupBy("block").cogroup(told.filter("block >= 0").groupBy("block")).applyInArrow(run, f"doc_id {kind}, held_out boolean, {FIELDS}")


def _rows(rows: list[tuple], fields: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [f.split() for f in fields.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])
