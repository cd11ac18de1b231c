"""Personal data: fixed patterns, and a skip-chain conditional random field over the tokens that look like them.

Variables are the tokens with a digit or an at sign, in text order; states are none and the four kinds. Potentials:
a log-linear one on a token's shape, one between neighbours in the chain, and a skip potential between tokens of one
document that are repeated or similar (same digits, digits that another's end in, or same letters and digits in lower case). Tokens inside base spans
are evidence. Damped loopy sum-product message passing gives each token's marginals; repeated tokens
that agree with an observed entity are added. Repeats are joined occurrence to occurrence, so edges grow with the
tokens, not with their square, and messages run over all edges of a document at once.

The weights are trained here, on a bounded sample of documents (SAMPLE, those with the smallest hash of their id) whose
labels are the base spans: softmax regression for shapes, log-ratios of counts for both kinds of edges. Set by hand are the counts of
agreement that skip edges start with (PRIOR), the bound of a shape's log-odds (UNARY) and that of a neighbour's (CHAIN), without which a
shape that base spans never have would outvote any repeat, and the certainty from which a token is added (SURE).

Defined results: null and empty texts have no spans; a null id stays null; spans are in code points, end exclusive; added spans overlap
neither base spans nor one another; repeated rows have equal spans, ties in the sample go by id and text; a very long text is one value
of one batch, numbers of any length among it; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import bounded_batches, own_worker

KINDS = ("email", "ip", "card", "phone")
STATES = 1 + len(KINDS)
SAMPLE, ROUNDS, DAMPING, SURE = 3_000, 12, 0.3, 0.8
#: Occurrences by which repeated tokens are taken to agree before any are seen; bound of a shape's log-odds.
PRIOR, UNARY, CHAIN = 120, 2.5, 1.0
# Fixed patterns of the contract; possessive where a failure needs no second try.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
# What may stand between the digit groups of one number, and the digits a number must share from its end to be taken for another's short form.
GAP = re.compile(r"[\x20().-]{1,3}")
TAIL, MOST_GROUPS = 7, 19
TOKEN = re.compile(r"[^\s,;:!?\"'<>]*[0-9@][^\s,;:!?\"'<>]*")
_DIGITS = bytes(48 if 48 <= c < 58 else 32 for c in range(256))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    found = []
    if b"@" in raw:
        at, last = text.find("@"), 0
        while at >= 0:
            start = at
            while start > last and text[start - 1] in LOCAL_CHARS:
                start -= 1
            m = DOMAIN.match(text, at) if start < at else None
            if m:
                found.append((0, start, m.end()))
                last = m.end()
            at = text.find("@", max(at + 1, last))
    if b"0" in raw.translate(_DIGITS):
        if b"." in raw:
            found += [(1, *m.span()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = re.sub(r"[ -]", "", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        if b"+" in raw:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def shape(token: str) -> list[float]:
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    parts = token.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts)
    only = "".join(c for c in token if "0" <= c <= "9") if len(token) <= 64 else ""
    n = max(1, len(token))
    return [
        1.0, digits / n, letters / n, min(n, 40) / 20, float(digits <= 2), float(3 <= digits <= 5), float(6 <= digits <= 8), float(9 <= digits <= 15), float(16 <= digits <= 19), float(digits > 19),
        float("@" in token), float(token[:1] == "+"), float("-" in token), float(token[:1] == "(" or token[-1:] == ")"), min(token.count("."), 5) / 3, float(quad), float(len(only) >= 16 and luhn(only)),
    ]


def similar_key(token: str) -> str | None:
    """Tokens with equal keys are repeated or similar; None where a token says too little."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    if "@" not in token and len(digits) >= 5:
        return digits
    word = "".join(c for c in token.lower() if c.isalnum())
    return word if "@" in token and len(word) >= 5 else None


def short_forms(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans outside of base spans whose digits, over several groups, are the last TAIL or more of a card or phone in base."""
    tails = {d[i:] for k, s, e in base if k >= 2 for d in ["".join(DIGITS.findall(text[s:e]))] for i in range(len(d) - TAIL + 1)}
    if not tails:
        return []
    marks, found, j, i = sorted((s, e) for _, s, e in base), [], 0, 0
    groups = [m.span() for m in DIGITS.finditer(text)]
    while i < len(groups):
        digits, best = "", 0
        for n, (a, b) in enumerate(groups[i : i + MOST_GROUPS], 1):
            if (n > 1 and not GAP.fullmatch(text, groups[i + n - 2][1], a)) or len(digits) + b - a > 19:
                break
            digits += text[a:b]
            if n > 1 and digits in tails:
                best = n
        if best:
            a, b = groups[i][0], groups[i + best - 1][1]
            a -= a > 0 and text[a - 1] == "(" and ")" in text[a:b]
            while j < len(marks) and marks[j][1] <= a:
                j += 1
            if not any(s < b and a < e for s, e in marks[j : j + len(KINDS)]):
                found.append((a, b))
                i += best - 1
        i += 1
    return found


class Chain:
    """Variables, evidence and edges of one document."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        marks, found, j = sorted((s, e, k + 1) for k, s, e in base), [], 0
        short, h = short_forms(text, base), 0
        for m in TOKEN.finditer(text):
            word = m[0].strip(".()[]{}")
            start = m.start() + m[0].index(word) if word else m.end()
            while j < len(marks) and marks[j][1] <= start:
                j += 1
            while h < len(short) and short[h][1] <= start:
                h += 1
            if h < len(short) and short[h][0] < start + len(word):
                continue
            if word and not any(s < start + len(word) and start < e for s, e, _ in marks[j : j + len(KINDS)]):
                found.append((start, start + len(word), 0))
        # A base span is one variable, observed; what lies outside of them is open.
        found = sorted(marks + found + [(s, e, 0) for s, e in short])
        self.spans, self.tokens = [(s, e) for s, e, _ in found], [text[s:e] for s, e, _ in found]
        n, self.known = len(found), np.array([k or -1 for *_, k in found], np.int64)
        ends = np.array([e for _, e in self.spans], np.int64)
        starts = np.array([s for s, _ in self.spans], np.int64)
        near = np.flatnonzero(starts[1:] - ends[:-1] <= 24) if n else np.zeros(0, np.int64)
        self.chain = np.stack([near, near + 1], axis=1)
        last: dict[str, int] = {}
        tails: dict[str, int] = {}
        skip = []
        for i, t in enumerate(self.tokens):
            key = similar_key(t)
            if key is not None:
                if key in last:
                    skip.append((last[key], i))
                elif key.isdigit() and (other := tails.get(key[-TAIL:])) is not None:
                    of = similar_key(self.tokens[other])
                    if min(len(key), len(of)) >= TAIL and (key.endswith(of) or of.endswith(key)):
                        skip.append((other, i))
                last[key] = i
                if key.isdigit():
                    tails[key[-TAIL:]] = i
        self.skip = np.array(skip, np.int64).reshape(-1, 2)


class Field:
    """The trained potentials, in logarithms."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, c: Chain) -> np.ndarray:
        """Sum-product messages over both directions of every edge, all edges at once."""
        node = np.array([shape(t) for t in c.tokens]) @ self.unary
        node = np.clip(node - node.mean(axis=1, keepdims=True), -UNARY / 2, UNARY / 2)
        seen = c.known >= 0
        node[seen] = -30.0
        node[seen, c.known[seen]] = 0.0
        edges = np.concatenate([c.chain, c.skip])
        if not len(edges):
            return _normal(node)
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        n, m = len(edges), len(c.chain)
        pair = np.empty((2 * n, STATES, STATES))
        pair[:m], pair[m:n], pair[n : n + m], pair[n + m :] = self.chain, self.skip, self.chain.T, self.skip.T
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        sent = np.zeros((2 * n, STATES))
        for _ in range(ROUNDS):
            belief = node.copy()
            np.add.at(belief, dst, sent)
            out = (belief[src] - sent[back])[:, :, None] + pair
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - sent).max()
            sent = DAMPING * sent + (1 - DAMPING) * new
            if moved < 1e-3:
                break
        belief = node.copy()
        np.add.at(belief, dst, sent)
        return _normal(belief)


def _normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(texts: list[str], ridge: float = 1e-3) -> Field:
    """Potentials from texts whose labels are their base spans; a token outside them is none."""
    x, y = [], []
    chain, skip = np.ones((STATES, STATES)), np.ones((STATES, STATES)) + PRIOR * np.eye(STATES)
    for t in texts:
        base = base_spans(t, t.encode("utf-8", "replace"))
        c = Chain(t, base)
        labels = np.maximum(c.known, 0)
        x += [shape(w) for w in c.tokens]
        y += labels.tolist()
        for counts, edges in ((chain, c.chain), (skip, c.skip)):
            if len(edges):
                np.add.at(counts, (labels[edges[:, 0]], labels[edges[:, 1]]), 1)
    xs, ys = np.array(x).reshape(len(x), -1) if x else np.array([shape("0")]), np.array(y or [0])
    w, onehot = np.zeros((xs.shape[1], STATES)), np.eye(STATES)[ys]
    for step in range(400):
        grad = xs.T @ (_normal(xs @ w) - onehot) / len(ys) + ridge * w
        w -= 2.0 / (1 + step / 200) * grad
    skip = (skip + skip.T) / 2
    ratio = lambda n: np.log(n / n.sum() / (n.sum(axis=1, keepdims=True) / n.sum()) / (n.sum(axis=0, keepdims=True) / n.sum()))
    own = np.sqrt(np.diag(skip))
    return Field(w, np.clip(ratio(chain), -CHAIN, CHAIN), np.log(skip / own[:, None] / own[None, :]))


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field, sure: float = SURE) -> list[tuple[int, int, int]]:
    """Tokens outside base spans that a repeated or similar token pulls to an entity's label."""
    c = Chain(text, base)
    if not len(c.skip) or (c.known >= 0).all():
        return []
    joined_ = np.zeros(len(c.tokens), bool)
    joined_[c.skip.ravel()] = True
    todo = np.flatnonzero(joined_ & (c.known < 0))
    if not len(todo):
        return []
    p = field.marginals(c)
    return sorted((int(k) - 1, *c.spans[i]) for i in todo.tolist() if (k := p[i].argmax()) and p[i, k] >= sure)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def fit(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """Trains on at most sample documents among those with an at sign or a plus sign before a digit."""
    rows = docs.where(F.col(text_col).rlike(r"@|\+[0-9]|[0-9]{5}")).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample)
    texts = docs.select(id_col, text_col).join(F.broadcast(rows), id_col)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # what training needs of a text: the stretches around its tokens
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([_excerpt(t or "") for t in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    # Texts become excerpts where they are read; only then are as many as the sample holds brought together.
    got = texts.mapInArrow(figures, "id long, text string").distinct().orderBy(F.xxhash64("id"), "id", "text").limit(sample).collect()
    return train([r.text for r in sorted(got, key=lambda r: (r.id is None, r.id, r.text))])


def _excerpt(text: str) -> str:
    """The text without the stretches that hold no token; longer gaps stay longer than what joins neighbours."""
    c = Chain(text, [])
    out, at = [], 0
    for a, b in c.spans:
        out.append(text[max(at, a - 48) : b] if a - at <= 96 else text[at : at + 48] + " " + text[a - 48 : b])
        at = b
    return "".join([*out, text[at : at + 48]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def scan_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("pii")
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                base = base_spans(text, text.encode("utf-8", "replace")) if text else []
                more = added_spans(text, base, field, sure) if text else []
                row = (*(sum(k == i for k, _, _ in base) for i in range(4)), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)))
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def find_pii(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bounded_batches(spark)
    return scan_pii(docs, fit(spark, docs, id_col, text_col), id_col, text_col)
