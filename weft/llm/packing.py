"""Best-fit packing of token pieces into sequences of a fixed capacity, large items matched in pairs.

Tokens. White-space chunks are tokenized as by the tokenizers library through a two-generation cache, which is exact because
the vocabulary's pre-splitting never crosses white space; new chunks are merged by rank, which is checked to be the same. Every document ends in token 0; only documents longer than the
capacity are cut.

Packing. Piece lengths are whole numbers up to the capacity, so the whole input is summed up by one histogram whose size
does not grow with it. On the histogram the driver plans runs of equal bins: pieces above a third of the capacity go at
most two to a bin, each matched with the largest partner that fits; the smaller ones then fill the smallest gap that
takes them, longest first. Executors look up their pieces' places: a piece's rank among those of its length selects
the run, the bin and the offset. The plan is global, so no bin is left half empty per partition, and nothing but the
histogram reaches the driver.

Defined results: a null or empty text is the one piece [0]; ties between pieces of a length go by slice, id and piece;
repeated rows get a place each; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import Scratch, bounded_batches, gathered, own_worker, worker_cache

CAPACITY, END = 2048, 0
#: Chunks of a cache generation; a longer chunk than LONG goes to the library.
CHUNKS, LONG = 200_000, 1_000
#: Bytes of texts whose chunks are told apart together: the more, the fewer of them are looked up.
GATHERED = 4 << 20
#: Pieces of one slice of one length, roughly: ranks are taken within such slices.
SLICE_ROWS = 2_000
# The vocabulary's fixed pre-splitting pattern, for characters of which \\w tells letters from the rest.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Texts that are not cut at white space: separators that the vocabulary takes for text, and the start of a special token.
_ODD = r"[\x1c-\x1f]|<\|"
_PLAIN = re.compile("[\x03-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
#: The byte that stands for the end of a word; chunks that hold it are not plain.
_STOP = "\x02"
# Names of the vocabulary file that quick_ids can take over.
_SUFFIX, _NORMAL, _PATTERN = "</w>", ("NFC", "Replace", "Lowercase"), "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def ranked_merges(path: str) -> list[bytes] | None:
    """The byte strings of the merges in order, if merging by the rank of the joined string is the same as merging by pairs.

    That is so if no two merges join to the same string, each joins tokens made before it, and every token's own string is
    merged into that token: then, once all merges before a token's are done, its string inside any word stands as the
    token's own pair or is cut by a token that crosses its ends. None where one of these, or the way words are split, doesn't hold.
    """
    from tokenizers import Tokenizer, models

    spec = json.load(open(path, encoding="utf-8"))
    model, normal, split = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    parts = split.get("pretokenizers", [])
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != _SUFFIX or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    if tuple(n["type"] for n in normal.get("normalizers", [])) != _NORMAL or [x["type"] for x in parts] != ["Split", "ByteLevel"] or parts[0]["pattern"].get("Regex") != _PATTERN:
        return None
    # The end of a word as one more symbol, joined to a word's last byte before all else.
    stop, chars = chr(0x250), _alphabet()
    named = lambda t: t[: -len(_SUFFIX)] + stop if t.endswith(_SUFFIX) else t
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    pairs = [(c, stop) for c in chars] + [(named(a), named(b)) for a, b in merges]
    made = {c: -1 for c in [*chars, stop]}
    for i, (a, b) in enumerate(pairs):
        if a + b in made or a not in made or b not in made:
            return None
        made[a + b] = i
    names = list(made)
    own = Tokenizer(models.BPE(vocab={t: i for i, t in enumerate(names)}, merges=pairs))
    if any(e.ids != [i] for i, e in enumerate(own.encode_batch_fast(names, add_special_tokens=False))):
        return None
    raw = chars | {stop: ord(_STOP)}
    return [bytes(raw[c] for c in a + b) for a, b in pairs]


class WordIds:
    """Ids of texts as little-endian 32-bit numbers, through a cache of white-space chunks.

    Chunks that aren't known yet go together through a merger by ranks, which gives the library's ids (ranked_merges) at a
    fraction of its time; where ranks won't do, and for chunks with characters beyond the plain ones, the library itself is asked.
    """

    def __init__(self, path: str, merges: list[bytes] | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunks, self.old_chunks, self.quick = {}, {}, None
        if merges:
            import tiktoken

            ranks = {bytes([b]): b for b in range(256)} | {m: 256 + i for i, m in enumerate(merges)}
            self.quick = tiktoken.Encoding("words", pat_str=rf"[^{_STOP} ]+{_STOP}| ", mergeable_ranks=ranks, special_tokens={})
            chars = {b: c for c, b in _alphabet().items()}
            vocab = self.library.get_vocab()
            spelt = lambda m: "".join(chars[b] for b in m.removesuffix(_STOP.encode())) + _SUFFIX * m.endswith(_STOP.encode())
            self.ids = np.array([vocab.get(spelt(m), 0) for m in ranks], "<u4")

    def direct(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Puts the ids of new chunks into the cache."""
        known, old = self.chunks, self.old_chunks
        again = [c for c in chunks if c in old]
        known.update(zip(again, map(old.__getitem__, again), strict=True))
        new = [c for c in chunks if c not in known]
        if self.quick is None or max(map(len, new), default=0) > LONG or not _PLAIN.fullmatch("".join(new)):
            odd = [c for c in new if self.quick is None or len(c) > LONG or not _PLAIN.fullmatch(c)]
            known.update((c, self.direct(c)) for c in odd)
            new = [c for c in new if c not in known]
        if new:
            ranks = np.array(self.quick.encode_ordinary(SPLIT.sub(rf"\g<0>{_STOP}", " ".join(new).lower())), np.int64)
            gaps = np.flatnonzero(ranks == ord(" "))
            data, stops = self.ids[np.delete(ranks, gaps)].tobytes(), [*((gaps - np.arange(len(gaps))) * 4).tolist(), 4 * (len(ranks) - len(gaps))]
            known.update(zip(new, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))

    def encode_batch(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text. Chunks are split and told apart by Arrow, so Python sees each one of a batch once."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = pc.list_flatten(lists).dictionary_encode()
        # Splitting leaves an empty string before or after white space at a text's ends; it has no ids.
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.chunks
        known[""] = b""
        self.learn([c for c in names if c not in known])
        ids = [known[c] for c in names]
        pool = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        places, at = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        counts = sizes[at]
        ends = np.cumsum(counts)
        tokens = pool[np.repeat(places[at] - (ends - counts), counts) + np.arange(counts.sum())].tobytes()
        bounds = (4 * np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        out = [tokens[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.direct(texts[i].as_py())
        if len(known) > CHUNKS:
            self.chunks, self.old_chunks = {}, known
        return out


@functools.lru_cache(maxsize=2)
def word_ids(path: str, ranked: bool | None = None) -> WordIds:
    """ranked: whether the merges are known to work by rank; asked of the file if not given."""
    return WordIds(path, ranked_merges(path) if ranked is None else _joined_merges(path) if ranked else None)


def _joined_merges(path: str) -> list[bytes]:
    """ranked_merges of a file that was checked before, without the check."""
    chars, stop = _alphabet(), _STOP.encode()
    raw = lambda t: bytes(chars[c] for c in t.removesuffix(_SUFFIX)) + stop * t.endswith(_SUFFIX)
    merges = json.load(open(path, encoding="utf-8"))["model"]["merges"]
    return [bytes([b]) + stop for b in chars.values()] + [raw(a) + raw(b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]


worker_cache("packing", word_ids.cache_clear)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: its document's ids from start on, length of them, and their checksum."""

    ranked = ranked_merges(path) is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("packing")
        end = np.array([END], "<u4").tobytes()
        for batch in gathered(batches, GATHERED):
            rows: list[tuple] = []
            for doc, data in zip(batch.column(0).to_pylist(), word_ids(path, ranked).encode_batch(batch.column(1)), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, PIECES)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces a bin, first bin, offset): where the pieces of each length go.

    Its cost depends on the number of different lengths, not on the counts.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    ranks = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins (first bin, bins)
    keys: list[int] = []  # the gaps, ascending
    bins = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(keys, gap)
            gaps[gap].append((first, n))

    def place(length: int, n: int, each: int, first: int, offset: int) -> None:
        runs.append((length, ranks[length], n, each, first, offset))
        ranks[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            i = bisect.bisect_right(large, min(capacity - a, a)) - 1
            while i >= 0 and not (left[large[i]] > 1 if large[i] == a else left[large[i]]):
                i -= 1
            if i < 0:
                n, b = left[a], 0
                place(a, n, 1, bins, 0)
            elif large[i] == a:
                n, b = left[a] // 2, a
                place(a, 2 * n, 2, bins, 0)
            else:
                b = large[i]
                n = min(left[a], left[b])
                place(a, n, 1, bins, 0)
                place(b, n, 1, bins, a)
            free(capacity - a - b, bins, n)
            bins += n
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[a]:
            i = bisect.bisect_left(keys, a)
            if i == len(keys):  # no gap takes it: new bins, as full of this length as they get
                each = min(capacity // a, left[a])
                n = left[a] // each
                place(a, n * each, each, bins, 0)
                free(capacity - each * a, bins, n)
                bins += n
                continue
            gap = keys[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], keys[i]
            each = min(gap // a, left[a])
            used = min(n, left[a] // each)
            place(a, used * each, each, first, capacity - gap)
            free(gap - each * a, first, used)
            free(gap, first + used, n - used)
    return runs


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece with its sequence and its offset there."""
    bounded_batches(spark)
    scratch = Scratch(spark, "pack")
    pieces = scratch.keep(token_pieces(docs, path, capacity, id_col, text_col), "pieces")
    slices = max(1, -(-pieces.count() // SLICE_ROWS))
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    # Counts by length and slice stay on the executors; the driver gets one number a length.
    counts = pieces.groupBy("length", "slice").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan_bins(histogram, capacity)
    before = counts.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("within", F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start")))
    ranked = ranked.join(before, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    # A few thousand runs at most, whatever the input: their number is bounded by the number of lengths.
    plan = F.broadcast(spark.createDataFrame(runs, "length long, r_first long, r_n long, r_each long, r_bin long, r_offset long"))
    placed = ranked.join(plan, ["length"]).where("rank >= r_first and rank < r_first + r_n")
    at = F.col("rank") - F.col("r_first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("r_bin") + F.floor(at / F.col("r_each"))).cast("long").alias("sequence_id"),
        (F.col("r_offset") + F.pmod(at, F.col("r_each")) * F.col("length")).cast("long").alias("offset"),
    )


__all__ = ["CAPACITY", "WordIds", "pack", "plan_bins", "token_pieces", "word_ids"]
