"""LM scoring: Katz backoff with Good-Turing discounts, exactly normalised, in partitioned tables.

Tokens are the words of a text and one end. Documents are cut into blocks of about BLOCK_TOKENS tokens; a block is one
compressed row of word hashes, written once. Counting works on blocks: each sends the distinct n-grams of its documents
with their counts, sorted and compressed, to the partition that owns their hash; the partition adds them up and answers
every block in the block's own order, so no n-gram travels once per occurrence. Partitions grow with the input, so each
holds a bounded share.

Model. With c the count of an n-gram and C that of its context, P(w | h) = d(c) c / C for c > 0, else alpha(h) P(w | h'), where
h' drops h's first token; a context never seen passes on to h' directly. d is Good-Turing's discount up to K (1 beyond). Where
the counts of counts as they are give a discount outside (0, 1), they are smoothed by a line in log-log scale first (Simple
Good-Turing); what falls back to absolute discounting by 1/2 is an order whose line falls no steeper than 1/r or has
fewer than two points, as no Good-Turing discount exists there. alpha(h) is what
the discounts free, divided by the lower order's mass of the words not seen after h: seen sums are taken over all seen
words, so the distribution over the vocabulary and one unknown token sums to one. The lowest order discounts words by their
counts alike and gives the unknown token what that frees (one occurrence where nothing is rare enough). The recursion runs order by
order: a block keeps the answers to its n-grams of every order, and works out each token's lower probabilities from them.

What the sum over seen words needs of the lower order travels as whole numbers: a word seen after h was seen after h' as often as
its count there says, so that count and the total of h' give its lower probability exactly.

Contexts so frequent that one partition can't hold their followers are spread over all partitions by the followers, and their
partial sums are added up; a context is taken for frequent from its count on, the start of a document among them. There are at most
as many of them as HOT, whatever the input, as each has a HOT-th of all tokens.

Defined results: a null or empty text is the end token alone; a row without an id is a training row; repeated rows are scored and counted
as often as they occur; ties don't arise; a very long text is a block of its own; an empty table gives no rows; other columns are not read;
without any training token every token is the unknown one with probability 1.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import Scratch, bounded_batches, free_shuffles, gathered, give_back, own_worker, word_hashes

ORDER, K = 3, 5
BLOCK_TOKENS = 1_000_000
#: Most frequent contexts; below that, as many as there are partitions.
HOT = 1 << 16
#: Bytes of texts whose words are told apart together.
GATHERED = 4 << 20
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
_STEP = np.uint64(6364136223846793005)
_Z = 3


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; a sorted array of hashes goes as differences, byte by byte of equal weight."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        shuffled = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes() if raw.itemsize > 1 else raw.tobytes()
        body = zstandard.compress(shuffled, _Z)
        parts.append(np.array([len(raw), len(body), ord(raw.dtype.char)], np.int64).tobytes() + body)
    return b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size, char = np.frombuffer(data, np.int64, 3, at).tolist()
        raw, kind = zstandard.decompress(data[at + 24 : at + 24 + size], max_output_size=max(1, 8 * n)), np.dtype(chr(char))
        a = np.frombuffer(raw, np.uint8)
        out.append(np.ascontiguousarray(a.reshape(kind.itemsize, n).T).view(kind).reshape(n) if kind.itemsize > 1 else a.view(kind))
        at += 24 + size
    return out


def _deltas(sorted_hashes: np.ndarray) -> np.ndarray:
    return np.diff(sorted_hashes, prepend=np.uint64(0))


def _hashes(deltas: np.ndarray) -> np.ndarray:
    return np.cumsum(deltas, dtype=np.uint64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and each element's value's number."""
    order = np.argsort(x)
    values = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return values[new], order[new], number


def _tuple_hash(columns: list[np.ndarray]) -> np.ndarray:
    """One hash a row of several key columns; a single column of keys stands for itself."""
    h = columns[0]
    for c in columns[1:]:
        h = (h * _STEP ^ (h >> np.uint64(29))) + (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def _narrow(a: np.ndarray) -> np.ndarray:
    """Unsigned numbers in 32 bits where they fit."""
    return a.astype(np.uint32) if not len(a) or a.max() < 1 << 32 else a


def _smallest(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts.astype(np.uint8)


def _arrow(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def blocks_of(docs: DataFrame, id_col: str, text_col: str, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(block, data): document ids, their token counts, the distinct word hashes and the tokens as indexes into them."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        lengths: list[int] = []
        words: list[np.ndarray] = []
        size, nth, part = 0, 0, 0
        own_worker("katz")

        def block() -> pa.RecordBatch:
            names, _, at = _distinct(np.concatenate(words))
            data = _pack(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.array(lengths, np.int64), _deltas(names), at.astype(np.uint32))
            return _arrow(["block", "data"], [pa.int64(), pa.binary()], [((part << 24) + nth, data)])

        for batch in gathered(batches, GATHERED):
            own, counts = word_hashes(batch.column(1))
            stops = np.cumsum(counts)
            for doc, p, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), (stops - counts).tolist(), stops.tolist(), strict=True):
                h = np.append(own[a:b], END)
                part = p
                ids.append(doc)
                lengths.append(len(h))
                words.append(h)
                size += len(h)
                if size >= tokens:
                    yield block()
                    ids, lengths, words, size, nth = [], [], [], 0, nth + 1
        if ids:
            yield block()

    return d.mapInArrow(run, "block long, data binary")


class Block:
    """The documents of a block as arrays over all of its tokens."""

    def __init__(self, data: bytes):
        ids, none, lengths, *names, self.word = _unpack(data)
        self.ids, self.none, self.lengths, self.names = ids, none.astype(bool), lengths, _hashes(names[0]) if names else None
        self.starts = np.cumsum(lengths) - lengths
        self.train_doc = np.array([bool(n) or not held_out(i) for i, n in zip(ids.tolist(), none.tolist(), strict=True)], bool)
        self.train = np.repeat(self.train_doc, lengths)
        self.place = (np.arange(len(self.word)) - np.repeat(self.starts, lengths)).astype(np.int32)

    def _back(self, n: int) -> np.ndarray:
        """The number, from 1 on, of the word n tokens before each token, 0 before a document's start."""
        out = np.zeros(len(self.word), np.int64)
        out[n:] = self.word[:-n].astype(np.int64) + 1
        out[self.place < n] = 0
        return out

    def contexts(self, n: int, keys: np.ndarray, parts: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the n - 1 tokens before each token: the distinct ones as columns of keys, ascending by the part that owns them and then
        by the columns; their parts; and each token's place among them. Key 0 stands for the start of a document."""
        named = np.concatenate([np.zeros(1, np.uint64), keys])
        back = [self._back(k) for k in range(n - 1, 0, -1)]
        at = back[0]
        for b in back[1:]:
            _, first, at = _distinct(at * np.int64(len(named)) + b)
        columns = [named[b[first]] for b in back] if n > 2 else [named]
        owner = _owner(_tuple_hash(columns), parts) if n > 2 else _word_owner(named, parts)
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return [c[order] for c in columns], owner[order], place[at]


def _smoothed(n: list[int]) -> list[float]:
    """Simple Good-Turing's counts of counts: the line through log(n(r) / half the gap between r's non-empty neighbours) over log r."""
    r = np.flatnonzero(n)
    if len(r) < 2:
        return [0.0] * len(n)
    before = np.append(0, r[:-1])
    after = np.append(r[1:], 2 * r[-1] - before[-1])
    slope, at_one = np.polyfit(np.log(r), np.log(2 * np.array(n, np.float64)[r] / (after - before)), 1)
    return [0.0, *np.exp(at_one + slope * np.log(np.arange(1, len(n)))).tolist()]


def discounts(counts_of_counts: dict[int, int], k: int = K) -> np.ndarray:
    """d(0..k+1): factors by which counts up to k are multiplied; the last one stands for all larger counts."""
    n = [0] + [counts_of_counts.get(r, 0) for r in range(1, k + 2)]
    d = np.ones(k + 2)
    for m in (n, _smoothed(n)):
        if all(m[1:]):
            tail = (k + 1) * m[k + 1] / m[1]
            good = [((r + 1) * m[r + 1] / m[r] / r - tail) / (1 - tail) if tail < 1 else 0.0 for r in range(1, k + 1)]
            if all(0 < g < 1 for g in good):
                d[1 : k + 1] = good
                return d
    d[1 : k + 1] = [1 - 0.5 / r for r in range(1, k + 1)]
    return d


def _sum_stats(stats: DataFrame) -> dict:
    """Counts of counts, distinct n-grams and tokens: a handful of numbers."""
    cols = [f"n{r}" for r in range(1, K + 2)] + ["distinct", "total"]
    row = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols)).first()
    return {"counts": {r: row[f"n{r}"] for r in range(1, K + 2)}, "distinct": row["distinct"], "total": row["total"]}


_STATS = [*(f"n{r}" for r in range(1, K + 2)), "distinct", "total"]


def _stats_row(counts: np.ndarray) -> tuple:
    seen = counts[counts > 0]
    return (*(int((seen == r).sum()) for r in range(1, K + 2)), len(seen), int(seen.sum()))


def _owner(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _word_owner(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys % np.uint64(parts)).astype(np.int64)


_SENT = "part long, block long, data binary"
_HOT = ["hot_ctx", "hot_n", *(f"hot_{r}" for r in range(1, K + 1)), "hot_seen"]
_ANSWER = "part long, block long, data binary, " + ", ".join(f"{c} long" for c in [*_STATS, *_HOT[:-1]]) + ", hot_seen double"
_ANSWER_NAMES = [f.split()[0] for f in _ANSWER.split(", ")]
_ANSWER_KINDS = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * (len(_STATS) + len(_HOT) - 1), pa.float64()]
_NO_STATS, _NO_HOT = (None,) * len(_STATS), (None,) * len(_HOT)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_STORED = "block long, data binary, counts binary, low binary"


def _cuts(owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(owner, from, to) of the runs of an ascending array."""
    if not len(owner):
        return []
    stops = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner))
    starts = np.append(0, stops[:-1])
    return list(zip(owner[starts].tolist(), starts.tolist(), stops.tolist(), strict=True))


def _table(names: list[str], kinds: list, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_arrow(names, kinds, rows)])


class Unigrams:
    """The lowest order: words by their discounted counts, and one unknown token with what the discounts free."""

    def __init__(self, stats: dict):
        self.total, self.distinct, self.d = stats["total"], stats["distinct"], discounts(stats["counts"])
        freed = sum((1 - self.d[r]) * r * stats["counts"][r] for r in range(1, K + 1))
        # Where no word is rare enough to be discounted, one occurrence more is the unknown token's.
        self.whole = self.total if freed > 0 else self.total + 1
        self.unknown = (freed if freed > 0 else 1) / self.whole

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, self.d[np.minimum(counts, K + 1)] * counts / self.whole, self.unknown)


def _scored(b: Block, counts: np.ndarray, p: np.ndarray, words: Unigrams) -> pa.Table:
    """The result's rows of one block: counts by word, probabilities by token."""
    base = np.log10((counts + 1) / (words.total + words.distinct + 1))[b.word]
    add = lambda x: np.add.reduceat(x, b.starts)
    cols = [pa.array(b.ids, mask=b.none), ~b.train_doc, b.lengths, add((counts > 0)[b.word].astype(np.int64)), np.full(len(b.ids), words.total, np.int64), add(base), add(np.log10(p))]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCORES.split(", ")])


def _with_answers(stored: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """run(block, data, counts, low, (part, answer) by part) -> rows, for each block. stored is dealt by block already where it is a
    bucketed table, so only the answers move."""

    def group(key: tuple[pa.Scalar, ...], one: pa.Table, t: pa.Table) -> pa.Table:
        give_back()
        got = sorted(zip(t["part"].to_pylist(), t["data"].to_pylist(), strict=True))
        return run(key[0].as_py(), *(one[c][0].as_py() for c in ("data", "counts", "low")), got)

    return stored.groupBy("block").cogroup(answers.select("block", "part", "data").groupBy("block")).applyInArrow(group, schema)


class Dealt:
    """Blocks as tables that are bucketed by block, in a scratch folder: what is joined with them by block moves, they don't."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.buckets, self.names = scratch, buckets, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        table = f"weft_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "block").option("path", self.scratch.path(name)).format("parquet").saveAsTable(table)
        self.names.append((table, name))
        return self.scratch.spark.table(table)

    def drop(self) -> None:
        """Forgets all tables but the last one."""
        for table, name in self.names[:-1]:
            self.scratch.spark.sql(f"drop table {table}")
            self.scratch.drop(name)
        del self.names[:-1]


class Level:
    """What a block knows of one order, by token: the probability, its n-gram's count, and its context's total with the lowest bit
    for whether any follower is rare enough to be discounted."""

    def __init__(self, p: np.ndarray, count: np.ndarray, total: np.ndarray):
        self.p, self.count, self.total = p, count, total


def _ngram_request(n: int, parts: int, words: Unigrams, hot_from: int, b: Block, c: np.ndarray, keys: np.ndarray, lower: Level | None) -> dict:
    """Distinct n-grams of a block as (context, word), in the order in which they are sent; index: each token's place there.

    Contexts are numbered by the part that owns them first, so sorting small whole numbers sorts by owner. A frequent context's n-grams
    are owned by their words' parts instead.
    """
    width = np.int64(len(keys) + 1)
    columns, ctx_owner, ctx = b.contexts(n, keys, parts)
    # How often each token's context occurs: the count of the n-gram of one order less that ends before it; documents start as often as they end.
    before = c[b.word] if lower is None else lower.count
    often = np.empty(len(before), np.int64)
    often[1:] = before[:-1]
    often[b.place == 0] = c[b.word[b.lengths[0] - 1]]
    token_hot = often >= hot_from
    # Grams are numbered by owner, cold before hot, context and word, so what goes to a part is one stretch of every array below.
    word_part = _word_owner(keys, parts)
    owner = np.where(token_hot, word_part[b.word], ctx_owner[ctx])
    first, index = _distinct(((2 * owner + token_hot) * np.int64(len(ctx_owner)) + ctx) * width + b.word)[1:]
    gram_ctx, gram_word, gram_hot, owner = ctx[first], b.word[first], token_hot[first], owner[first]
    del often, before, ctx, token_hot
    new = np.ones(len(first), bool)
    new[1:] = (gram_ctx[1:] != gram_ctx[:-1]) | (owner[1:] != owner[:-1]) | (gram_hot[1:] != gram_hot[:-1])
    starts = np.flatnonzero(new)
    q = {
        "index": index, "sent_low": c[gram_word] if lower is None else lower.count[first], "keys": gram_word, "slices": _cuts(owner), "starts": starts,
        "lengths": np.diff(np.append(starts, len(first))), "hot": gram_hot[starts], "columns": columns, "context": gram_ctx[starts],
        "low_total": None if lower is None else lower.total[first[starts]],
    }
    q["low"] = words(q["sent_low"]) if lower is None else lower.p[first]
    return q


def _add_words(t: pa.Table) -> pa.Table:
    """Counts of a part's words, in the order of each block that asked, and their ranks among the part's words, the most frequent one first."""
    got = [(p, block, *_unpack(data)) for p, block, data in zip(*(t[c].to_pylist() for c in ("part", "block", "data")), strict=True)]
    names, _, at = _distinct(np.concatenate([_hashes(d) for _, _, d, _ in got]))
    total = np.bincount(at, np.concatenate([n for *_, n in got]).astype(np.float64), len(names)).astype(np.int64)
    rank = np.empty(len(names), np.uint32)
    rank[np.argsort(-total, kind="stable")] = np.arange(1, len(names) + 1, dtype=np.uint32)
    rows, i = [], 0
    for p, block, d, _ in got:
        mine = at[i : i + len(d)]
        rows.append((p, block, _pack(_smallest(total[mine]), rank[mine]), *_NO_STATS, *_NO_HOT))
        i += len(d)
    rows.append((got[0][0], None, None, *_stats_row(total), *_NO_HOT))
    return _table(_ANSWER_NAMES, _ANSWER_KINDS, rows)


def _adder(n: int, words: Unigrams, d_lower: np.ndarray | None):
    def add_ngrams(t: pa.Table) -> pa.Table:
        give_back()
        return add(t)

    def add(t: pa.Table) -> pa.Table:
        """Counts of a part's n-grams for each block that asked; of their contexts: the followers' total, how many of them
        occur once, twice, ... up to K times, and the lower order's mass of those that occur at all."""
        got = [(p, block, _unpack(data)) for p, block, data in zip(*(t[c].to_pylist() for c in ("part", "block", "data")), strict=True)]
        columns = [np.concatenate([_hashes(a[6 if d_lower is not None else 5]) for *_, a in got])]
        columns += [np.concatenate([a[k] for *_, a in got]).astype(np.uint64) for k in range(7, 7 + n - 2)]
        _, some, run_ctx = _distinct(columns[0])
        for c in columns[1:]:
            values, _, at = _distinct(c)
            _, some, run_ctx = _distinct(run_ctx * np.int64(len(values)) + at)
        n_names = len(some)
        ctx = np.repeat(run_ctx, np.concatenate([a[1] for *_, a in got]))
        word_names, _, word = _distinct(np.concatenate([a[2] for *_, a in got]))
        width = np.int64(len(word_names) + 1)
        _, first, at = _distinct(ctx * width + word)
        del word, word_names
        total = np.bincount(at, np.concatenate([a[4] for *_, a in got]).astype(np.float64), len(first)).astype(np.int64)
        of, low = ctx[first], np.concatenate([a[3] for *_, a in got])[first].astype(np.int64)
        if d_lower is None:
            low = words(low)
        else:
            under = np.concatenate([np.repeat(a[5], a[1]) for *_, a in got])[first]
            low = _seen_probability(low, d_lower, under.astype(np.int64))
            del under
        sums = [np.bincount(of, total.astype(np.float64), n_names).astype(np.int64)]
        sums += [np.bincount(of, total == r, n_names).astype(np.int64) for r in range(1, K + 1)]
        mass = np.bincount(of, np.where(total > 0, low, 0.0), n_names)
        # The lowest bit of what goes for the total: whether any follower is rare enough to be discounted.
        shown = [2 * sums[0] + (sum(sums[1:]) > 0), *sums[1:]]
        is_hot = np.zeros(n_names, bool)
        is_hot[run_ctx] = np.concatenate([a[0] for *_, a in got]).astype(bool)
        names = _tuple_hash([c[some] for c in columns])
        rows, i, r = [], 0, 0
        for p, block, a in got:
            mine, runs = at[i : i + len(a[2])], run_ctx[r : r + len(a[0])]
            i, r = i + len(a[2]), r + len(a[0])
            n_of = total[mine]
            backs_off = np.bincount(np.repeat(np.arange(len(runs)), a[1])[n_of == 0], minlength=len(runs)) > 0
            rows.append((p, block, _pack(_smallest(n_of), *(_smallest(np.where(backs_off | (k == 0), x[runs], 0)) for k, x in enumerate(shown)), np.where(backs_off, mass[runs], 0.0)), *_NO_STATS, *_NO_HOT))
        rows.append((got[0][0], None, None, *_stats_row(total), *_NO_HOT))
        for k in np.flatnonzero(is_hot).tolist():
            rows.append((got[0][0], None, None, *_NO_STATS, int(names[k : k + 1].view(np.int64)[0]), *(int(x[k]) for x in sums), float(mass[k])))
        return _table(_ANSWER_NAMES, _ANSWER_KINDS, rows)

    return add_ngrams


def _seen_probability(count: np.ndarray, d: np.ndarray, total: np.ndarray) -> np.ndarray:
    """d(c) c / C of n-grams that occur, 0 of others; total holds C and, in its lowest bit, whether anything after h is rare."""
    whole = total >> 1
    whole = whole + np.where((whole > 0) & (total & 1 == 0), 0.5, 0.0)
    return np.where(count > 0, d[np.minimum(count, K + 1)] * count / np.maximum(whole, 1), 0.0)


def _katz(total: np.ndarray, low: np.ndarray, ctx_at: np.ndarray, n_ctx: np.ndarray, rare: np.ndarray, once: list[np.ndarray], mass: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P(w | h) of n-grams from their counts, the lower order's probabilities and their contexts' sums. rare: whether a
    context has followers to discount; the sums beside n_ctx are asked for only where some n-gram backs off."""
    freed = sum((1 - d[r]) * r * once[r - 1] for r in range(1, K + 1))
    # A context all of whose followers are too frequent to be discounted keeps half an occurrence for the others.
    kept_back = np.where((n_ctx > 0) & ~rare, 0.5, 0.0)
    n_all = n_ctx + kept_back
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(n_ctx > 0, (freed + kept_back) / n_all / (1 - mass), 1.0)
        seen = d[np.minimum(total, K + 1)] * total / n_all[ctx_at]
    return np.where(total > 0, seen, alpha[ctx_at] * low)


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row a row of docs."""
    bounded_batches(spark)
    scratch = Scratch(spark, "katz")
    blocks = scratch.keep(blocks_of(docs, id_col, text_col, block_tokens), "blocks")
    # As many parts as blocks, so what one part adds up is about as large as a block.
    parts = max(1, min(1 << 20, blocks.count()))

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Block(data)
                n = np.bincount(b.word[b.train], minlength=len(b.names))
                yield _arrow(["part", "block", "data"], [pa.int64(), pa.int64(), pa.binary()], [(p, block, _pack(_deltas(b.names[i:j]), _smallest(n[i:j]))) for p, i, j in _cuts(_owner(b.names, parts))])

    answers = scratch.keep(blocks.mapInArrow(send_words, _SENT).groupBy("part").applyInArrow(_add_words, _ANSWER), "answers-1")
    words = Unigrams(_sum_stats(answers))
    hot_from = max(2, words.total // min(HOT, 2 * parts))
    stored = blocks.select("block", "data", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("low"))

    def first(block: int, data: bytes, _c, _l, got: list) -> pa.Table:
        b, got = Block(data), [(part, *_unpack(x)) for part, x in got]
        counts = np.concatenate([x[1].astype(np.int64) for x in got])
        if order == 1:
            return _scored(b, counts, words(counts)[b.word], words)
        # A word's key: its rank in its part, then the part, so that keys are small numbers in about the order of the words' counts.
        # From here on a block's words go by their keys.
        keys = np.concatenate([rank.astype(np.uint64) * np.uint64(parts) + np.uint64(part) for part, _, rank in got])
        by_key = np.argsort(keys)
        # Tokens are stored as their words' places by count, which compress better.
        place = np.empty(len(keys), np.uint32)
        place[by_key[_by_count(counts[by_key])]] = np.arange(len(keys), dtype=np.uint32)
        return _table(["block", "data", "counts", "low"], [pa.int64(), *[pa.binary()] * 3], [(block, _pack(b.ids, b.none.view(np.uint8), b.lengths, place[b.word]), _pack(_smallest(counts[by_key]), _deltas(keys[by_key])), None)])

    if order == 1:
        return _with_answers(stored, answers.where("block is not null"), first, SCORES)
    dealt = Dealt(scratch, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored = dealt.keep(_with_answers(stored, answers.where("block is not null"), first, _STORED), "order_1")
    scratch.drop("blocks", "answers-1")
    known: list[tuple] = []
    for n in range(2, order + 1):
        free_shuffles(spark)
        out = _raise(scratch, stored, n, parts, words, hot_from, known, last=n == order)
        if n < order:
            stored = dealt.keep(out, f"order_{n}")
            scratch.drop(f"answers-{n}")
            dealt.drop()
    return out


def _by_count(counts: np.ndarray) -> np.ndarray:
    """The places of counts, the largest count first."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _framed(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _level(q: dict, got: list[bytes], d: np.ndarray, hot_names: np.ndarray, hot_sums: np.ndarray) -> Level:
    """A request's answers as probabilities, counts and contexts' totals by token."""
    answers = [_unpack(x) for x in got]
    total, n_ctx = (np.concatenate([a[k] for a in answers]).astype(np.int64) for k in (0, 1))
    once = [np.concatenate([a[1 + r] for a in answers]).astype(np.float64) for r in range(1, K + 1)]
    mass = np.concatenate([a[K + 2] for a in answers])
    del answers
    rare, n_ctx = (n_ctx & 1) > 0, (n_ctx >> 1).astype(np.float64)
    at = np.flatnonzero(q["hot"])
    if len(at) and len(hot_names):
        names = _tuple_hash([x[q["context"][at]] for x in q["columns"]])
        k = np.searchsorted(hot_names, names).clip(max=len(hot_names) - 1)
        at, k = at[hot_names[k] == names], k[hot_names[k] == names]
        sums = hot_sums[k].T
        for x, y in zip([n_ctx, *once, mass], sums, strict=True):
            x[at] = y
        rare[at] = sums[1 : K + 1].sum(axis=0) > 0
    runs = np.repeat(np.arange(len(q["lengths"])), q["lengths"])
    probs = _katz(total, q["low"], runs, n_ctx, rare, once, mass, d)
    whole = (2 * n_ctx.astype(np.int64) + rare)[runs]
    return Level(probs[q["index"]], total[q["index"]], whole[q["index"]])


def _raise(scratch: Scratch, stored: DataFrame, n: int, parts: int, words: Unigrams, hot_from: int, known: list[tuple], last: bool) -> DataFrame:
    """From the answers up to order n - 1 to those of order n; scores where it is the last one. known: the discounts and frequent
    contexts of the orders from 2 on, to which this one's are added."""
    below = list(known)

    def lower(b: Block, c: np.ndarray, keys: np.ndarray, low: bytes | None) -> Level | None:
        level = None
        for m, (answers, of) in enumerate(zip(_unframed(low or b""), below, strict=True), 2):
            level = _level(_ngram_request(m, parts, words, hot_from, b, c, keys, level), _unframed(answers), *of)
        return level

    def request(data: bytes, counts: bytes, low: bytes | None) -> tuple[Block, np.ndarray, dict, np.ndarray]:
        b, (c, keys) = Block(data), _unpack(counts)
        c, keys = c.astype(np.int64), _hashes(keys)
        b.word = _by_count(c)[b.word]
        return b, c, _ngram_request(n, parts, words, hot_from, b, c, keys, lower(b, c, keys, low)), keys

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *s in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                give_back()
                b, _, q, word_keys = request(*s)
                seen = _smallest(np.bincount(q["index"][b.train], minlength=len(q["keys"])))
                low, keys, lengths = _smallest(q["sent_low"]), _narrow(word_keys[q["keys"]]), _smallest(q["lengths"])
                under = None if q["low_total"] is None else _smallest(q["low_total"])
                columns, hot = [x[q["context"]] for x in q["columns"]], q["hot"].view(np.uint8)
                later = [_narrow(x) for x in columns[1:]]
                rows = np.searchsorted(q["starts"], [i for _, i, _ in q["slices"]] + [len(q["keys"])]).tolist()
                for (part, i, j), r, z in zip(q["slices"], rows, rows[1:]):
                    data = _pack(hot[r:z], lengths[r:z], keys[i:j], low[i:j], seen[i:j], *([] if under is None else [under[r:z]]), _narrow(_deltas(columns[0][r:z])), *(x[r:z] for x in later))
                    yield _arrow(["part", "block", "data"], [pa.int64(), pa.int64(), pa.binary()], [(part, block, data)])

    sent = stored.select("block", "data", "counts", "low").mapInArrow(send, _SENT)
    answers = scratch.keep(sent.groupBy("part").applyInArrow(_adder(n, words, below[-1][0] if below else None), _ANSWER), f"answers-{n}")
    del sent
    free_shuffles(scratch.spark)
    d = discounts(_sum_stats(answers)["counts"])
    # The frequent contexts, added up before they get here: at most HOT rows, as each has a HOT-th of all tokens.
    hot = {r.hot_ctx: tuple(r)[1:] for r in answers.where("hot_ctx is not null").groupBy("hot_ctx").agg(*(F.sum(c).alias(c) for c in _HOT[1:])).collect()}
    hot_names = np.array(sorted(h & (2**64 - 1) for h in hot), np.uint64)
    hot_sums = np.array([hot[int(h)] for h in hot_names.view(np.int64)], np.float64).reshape(-1, K + 2)
    known.append((d, hot_names, hot_sums))

    def take(block: int, data: bytes, counts: bytes, low: bytes | None, got: list) -> pa.Table:
        if not last:
            return _table(["block", "data", "counts", "low"], [pa.int64(), *[pa.binary()] * 3], [(block, data, counts, (low or b"") + _framed([_framed([x for _, x in got])]))])
        b, c, q, _ = request(data, counts, low)
        return _scored(b, c, _level(q, [x for _, x in got], d, hot_names, hot_sums).p, words)

    return _with_answers(stored, answers.where("block is not null"), take, SCORES if last else _STORED)
