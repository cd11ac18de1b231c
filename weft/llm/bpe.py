"""BPE as a tokenization automaton: merges are compiled into a deterministic automaton, words run through its tables.

Construction. The automaton starts with one arc a byte from every state. Merges are applied in order, each by a gadget:
for a merge u v -> w the state after u is split, the split-off copy loses its arc v, and a new arc w is laid beside every
arc u, leading to what is then the state after v. Every token thus owns one state, "after this token", which is a version
of another token's state. The tables keep, for every token, the step at which its state was made (``born``), whose
state it copied (``copy_of``), beside whose arcs its own arcs run (``beside``), and for every pair the step at which the
arc was cut (``cut``). An arc from the state after p with label x exists iff unwinding the gadgets in reverse order meets
no cut.

Compilation. The accepted token paths are exactly the correct tokenizations, a prefix of a correct path is correct, and each
prefix has one path. A state of the byte automaton is what a prefix leaves for later: for every place where a token may have begun, the
token state there and the place in a trie of labels that the bytes since have reached. One byte leads from a state to the next; the
token that ends there, the one whose arc its state has, is the next state's label. This is the subset construction over the token
automaton, run as states are met, as regular expression engines do it: all states of a vocabulary of this size would not fit a worker. The
table is emptied when it holds STATES states, which changes times, not results.

Encoding. A word is read byte by byte through the table, one look-up a byte; the labels of its states, followed from the end, are its
tokens. Decoding emits the arcs' labels.

Defined results: a null or empty text has no tokens and decodes to the empty text. Special tokens in a text are taken as
such, like the library does by default. Everything is per row, so repeated rows have equal results and ties don't arise; a null id stays
null; an empty table gives no rows; a very long text is one value of one batch, a very long word one run through the table; other columns are
not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from weft.llm.common import gathered, own_worker, worker_cache

_WS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The fixed pre-splitting pattern of the vocabulary, with white space spelled out.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Where a text can't be cut at every single space: white space beside it, or a space at the text's ends.
_ODD_CUT = r" [\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |^ | $"
#: Bytes of texts whose pieces are told apart together.
GATHERED = 2 << 20
#: Entries of a worker's word cache before the older half goes; arcs that are remembered, and states of the compiled automaton, before
#: they are emptied.
WORDS, ARCS, STATES = 320_000, 300_000, 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        chars, vocab = byte_alphabet(), spec["model"]["vocab"]
        label = {name: bytes(chars[c] for c in name) for name in vocab}
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.labels: list[bytes] = [b""] * size
        for name, i in vocab.items():
            self.labels[i] = label[name]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.special.items():
            self.labels[i] = name.encode()
        self.born, self.copy_of, self.beside = [0] * size, [0] * size, [0] * size
        self.cut: dict[int, int] = {}
        for step, merge in enumerate(spec["model"]["merges"], 1):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self._gadget(step, vocab[a], vocab[b], vocab[a + b])
        # The trie of labels: children by place and byte, and the token that ends at a place.
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for name, i in vocab.items():
            at = 0
            for byte in label[name]:
                nxt = self.child.get(at << 8 | byte)
                if nxt is None:
                    nxt = self.child[at << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                at = nxt
            self.ends[at] = i
        self._forget()
        self.arcs: dict[int, bool] = {}
        self.special_pattern = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        """One merge: cut the arc v after u; w's arcs run beside u's and lead to a copy of the state after v as it was."""
        self.cut[u << 20 | v] = step
        self.born[w], self.beside[w], self.copy_of[w] = step, u, v

    def passes(self, p: int, x: int) -> bool:
        """Whether the state after token p has an arc x."""
        key = p << 20 | x
        if (known := self.arcs.get(key)) is not None:
            return known
        upto, a, b = 1 << 30, p, x
        while True:
            cut = self.cut.get(a << 20 | b)
            if cut is not None and cut <= upto:
                answer = False
                break
            made_a, made_b = self.born[a], self.born[b]
            if not made_a and not made_b:
                answer = True
                break
            if made_a < made_b:  # beside the arcs that are left after the step's own cut: for u u -> w, none after u
                b, upto = self.beside[b], made_b
            else:  # a copy of the state as it was before the step's cut
                b = self.beside[b] if made_a == made_b else b
                a, upto = self.copy_of[a], made_a - 1
        if len(self.arcs) >= ARCS:
            self.arcs.clear()
        self.arcs[key] = answer
        return answer

    def _forget(self) -> None:
        """Empties the compiled automaton but for its start, state 0."""
        # A state: pairs (token state where a token may have begun, place in the trie), then its label; -1 is the state at a word's start.
        self.kept: list[tuple[int, ...]] = [(-1, 0, -1)]
        self.numbers: dict[tuple[int, ...], int] = {(-1, 0, -1): 0}
        self.label: list[int] = [-1]
        #: The transition table: from a state and a byte, as one number, to a state.
        self.table: dict[int, int] = {}

    def _compile(self, state: int, byte: int) -> int:
        """The state that a byte leads to, made if it is not there yet."""
        child, ends, pairs, label, kept = self.child.get, self.ends, iter(self.kept[state]), -1, []
        for before, place in zip(pairs, pairs):
            at = child(place << 8 | byte)
            if at is None:
                continue
            kept += (before, at)
            token = ends[at]
            # Of the tokens that end here one has an arc from the state where it begins; a whole word's token always has.
            if label < 0 <= token and (before < 0 or self.passes(before, token)):
                label = token
        key = (*kept, label, 0, label)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.kept)
            self.kept.append(key)
            self.label.append(label)
        self.table[state << 8 | byte] = number
        return number

    def word(self, data: bytes) -> list[int]:
        """The token path of one pre-split word."""
        if len(self.kept) > STATES:
            self._forget()
        follow, state, passed = self.table.get, 0, []
        for byte in data:
            nxt = follow(state << 8 | byte)
            state = self._compile(state, byte) if nxt is None else nxt
            passed.append(state)
        out, at, label, labels = [], len(data), self.label, self.labels
        while at:
            token = label[passed[at - 1]]
            out.append(token)
            at -= len(labels[token])
        return out[::-1]

    def plain(self, text: str) -> list[int]:
        """Tokens of a text without special tokens."""
        return [t for w in SPLIT.findall(text) for t in self.word(w.encode())]

    def encode(self, text: str) -> list[int]:
        if self.special_pattern is None:
            return self.plain(text)
        out: list[int] = []
        for part in self.special_pattern.split(text):
            if part:
                out += [self.special[part]] if part in self.special else self.plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


class Generations(dict):
    """A cache of two generations: when the young one is full it becomes the old one, so frequent keys stay."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> tuple[Automaton, Generations, Generations]:
    """One automaton a worker; with the paths of single words, alone and of what follows a space: the decimal ids, their number, and the
    bytes that their arcs' labels spell."""
    a = Automaton(path)
    name, label = [str(i) for i in range(len(a.labels))].__getitem__, a.labels.__getitem__

    def of_word(w: str) -> tuple[str, int, bytes]:
        ids = a.word(w.encode())
        return ",".join(map(name, ids)), len(ids), b"".join(map(label, ids))

    words = Generations(of_word, WORDS)
    return a, words, Generations(lambda c: joined([words[w] for w in SPLIT.findall(" " + c)]), WORDS)


def joined(parts: list[tuple[str, int, bytes]]) -> tuple[str, int, bytes]:
    """Paths one after the other."""
    if len(parts) == 1:
        return parts[0]
    return ",".join([p[0] for p in parts]), sum(p[1] for p in parts), b"".join([p[2] for p in parts])


worker_cache("bpe", automaton.cache_clear)


def path_of(text: str, path: str) -> tuple[str, int, bytes]:
    """A text's path, special tokens among it."""
    a, words, _ = automaton(path)
    parts = a.special_pattern.split(text) if a.special_pattern is not None else [text]
    found: list[tuple[str, int, bytes]] = []
    for p in parts:
        if p and len(parts) > 1 and p in a.special:
            found.append((str(a.special[p]), 1, a.labels[a.special[p]]))
        elif p:
            found += [words[w] for w in SPLIT.findall(p)]
    return joined(found)


def decimal_ids(text: str, path: str) -> str:
    """The ids of a text in decimal, joined by commas."""
    return path_of(text, path)[0]


def paths_of(texts: pa.Array, path: str) -> list[tuple[str, int, bytes]]:
    """The paths of a batch of texts. Texts that may be cut at every space are: Arrow cuts them and tells what follows a space apart, so
    each such piece of the batch is looked up once."""
    a, words, spaced = automaton(path)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    odd = pc.match_substring_regex(texts, _ODD_CUT)
    for special in a.special:
        odd = pc.or_(odd, pc.match_substring(texts, special))
    lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    coded = pc.list_flatten(lists).dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    at, bounds = coded.indices.to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    # The first piece of a text has no space before it.
    inner = np.ones(len(at), bool)
    inner[bounds[:-1]] = False
    wanted = np.zeros(len(names), bool)
    wanted[at[inner]] = True
    known = [spaced[n] if w else ("", 0, b"") for n, w in zip(names, wanted.tolist(), strict=True)]
    decimals, spelt, sizes = [k[0] for k in known], [k[2] for k in known], np.array([k[1] for k in known], np.int64)[at]
    out = []
    for text_is_odd, i, j, text in zip(odd.to_pylist(), bounds[:-1], bounds[1:], texts, strict=True):
        if text_is_odd:
            out.append(path_of(text.as_py(), path))
            continue
        head = joined([words[w] for w in SPLIT.findall(names[at[i]])]) if names[at[i]] else ("", 0, b"")
        rest = at[i + 1 : j].tolist()
        if not rest:
            out.append(head)
            continue
        first = [head[0]] if head[1] else []
        out.append((",".join([*first, *map(decimals.__getitem__, rest)]), head[1] + int(sizes[i + 1 : j].sum()), head[2] + b"".join(map(spelt.__getitem__, rest))))
    return out


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Every row's whole text encoded, then decoded from its path. keep_ids: whether the ids themselves are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("bpe")
        for batch in gathered(batches, GATHERED):
            n, enc, dec, kept = [], [], [], []
            for s, size, spelt in paths_of(batch.column(1), path):
                n.append(size)
                enc.append(hashlib.sha256(s.encode()).hexdigest())
                dec.append(hashlib.sha256(spelt.decode("utf-8", "replace").encode()).hexdigest())
                kept.append([int(i) for i in s.split(",") if i] if keep_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string()), pa.array(kept, pa.list_(pa.int32()))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
