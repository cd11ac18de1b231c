"""Secret scans: patterns, and dictionary-primed zstandard novelty.

Base spans come from three fixed patterns. The method adds spans: a string of key-like characters in a sensitive context
is measured by the bytes it adds to the compressed form of the text around it. The compressor is primed with a dictionary
made of identifiers and of the surrounding text, so words, identifiers and repeated strings cost next to nothing, whereas
random keys cost nearly their own entropy. The identifiers are a few fixed ones and those that the corpus has most often near sensitive
words: all documents are counted, and only names made of words count, so that a key in many copies of a document doesn't hide itself.
Candidates that cost at least ``BITS`` a character are reported, whatever their length; parts joined by dots are one candidate. What
consists of parts of words is none (an identifier, a path, a sentence), nor are digits alone, whose 3.3 bits at most are below ``BITS``.

Defined results: null and empty texts have no spans; a null id stays null. Spans are in code points, end exclusive. Added spans never overlap
a base span or one another. Repeated rows have equal spans (with a corpus' identifiers too: they depend on all rows, not on their order, ties in
their counts going by name); a very long text is one value of one batch; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import own_worker

KINDS = ("assign", "access", "hex", "novel")
# Fixed patterns of the contract.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Runs of key-like characters with at least MIN_NOVEL of them, and words near them that make a context sensitive.
MIN_NOVEL, AROUND, BITS = 16, 96, 4.0
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_=-]++(?:\.[A-Za-z0-9+/_=-]++)*+")
#: Names that the corpus gives to the dictionary: how many at most, what they look like.
CORPUS_NAMES = 1_500
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]{5,63}")
# A word starts and ends where letters do, or at a change of case as in secretKey and AWSSecret; '_' and digits bound it.
_EDGE = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
SENSITIVE = re.compile(
    rf"(?:(?<![^\W\d_])|{_EDGE})(?i:pass(?:words?|wd|phrase)?|pwd|secrets?|tokens?|credentials?|bearer|authorization|auth"
    r"|(?:api|access|private|secret|client|session|signing|encryption|master|account|storage|shared|service|deploy|ssh)[_ -]?(?:access[_ -]?)?keys?"
    rf"|client[_ -]?secret)(?:(?![^\W\d_])|{_EDGE})"
)
# Longer runs are also measured piece by piece.
PIECE = 512
#: Pairs of letters that words are mostly made of; a part of a string is taken for a word where WORDLIKE of its pairs are among them,
#: and the string for a name where such parts hold COVERED of its letters.
WORDLIKE, COVERED = 0.55, 0.6
PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la "
    "ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi "
    "ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke fr oo av ag if ap gr od bo sp rd do uc bu ei ov by rm ep tt oc fa ef cu rn sc gi da yo cr cl du ga qu "
    "ue ff ba ey ls va um pp ua up lu go ht ru ug ds lt pi rc rr eg au ck ew mu br bi pt ak pu ui rg ib tl ny ki rk ys ob mm fu ph og ms ye ud mb ip ub oi rl gu dr hr".split()
)
_SENSITIVE_BYTES = (b"pass", b"pwd", b"secret", b"token", b"credential", b"bearer", b"auth", b"key")
#: Identifiers that prime the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret authorization bearer "
    "username user_name account_id session_id request_id connection_string database_url endpoint environment configuration "
    "application production development staging default localhost hostname container_name service_account get_object put_object "
    "create_session initialize_connection validate_request response_handler function return import class const static public private "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx aaaaaaaa ======== -------- ________"
).encode()
_HEXMAP = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))


def _compressed(data: bytes, primer: bytes) -> int:
    d = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False).compress(data))


def novelty(candidate: str, around: str, identifiers: bytes = IDENTIFIERS) -> float:
    """Bits a character that candidate adds to a text compressed with the identifiers and its surroundings as dictionary."""
    primer = identifiers + b"\n" + around.encode("utf-8", "replace")
    body = candidate.encode()
    return 8 * (_compressed(b"= " + body, primer) - _compressed(b"= ", primer)) / max(1, len(body))


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, each leftmost and non-overlapping within its kind."""
    raw = text.encode("utf-8", "replace") if raw is None else raw
    low, found = raw.lower(), []
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"h" * 24 in raw.translate(_HEXMAP):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def wordlike(candidate: str) -> bool:
    """Whether most letters stand in parts of three and more, of one case but for a first capital, whose pairs are as in words."""
    letters = sum(map(str.isalpha, candidate))
    held = 0
    for x in PART.findall(candidate):
        low = x.lower()
        if len(low) >= 3 and sum(low[i : i + 2] in PAIRS for i in range(len(low) - 1)) >= WORDLIKE * (len(low) - 1):
            held += len(low)
    return held >= COVERED * letters


def _novel_parts(text: str, a: int, b: int, bits: float, identifiers: bytes) -> list[tuple[int, int]]:
    """The run if it reaches bits as a whole; of a longer one that doesn't, the joined pieces that do."""

    def new(x: int, y: int) -> bool:
        return not wordlike(text[x:y]) and novelty(text[x:y], text[max(0, x - 2048) : x] + " " + text[y : y + 2048], identifiers) >= bits

    if new(a, b):
        return [(a, b)]
    found: list[tuple[int, int]] = []
    for x in range(a, b, PIECE) if b - a > PIECE else ():
        y = min(b, x + PIECE)
        if y - x >= MIN_NOVEL and new(x, y):
            found[-1:] = [(found[-1][0], y)] if found and found[-1][1] == x else [*found[-1:], (x, y)]
    return found


def novel_spans(text: str, raw: bytes, base: list[tuple[int, int, str]], bits: float = BITS, identifiers: bytes = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """Key-like strings near a sensitive word, or next lines of one found, that the primed compressor can't shorten."""
    low = raw.lower()
    if not any(k in low for k in _SENSITIVE_BYTES):
        return []
    near = [m.span() for m in SENSITIVE.finditer(text)]
    if not near:
        return []
    found, last, i, j, base = [], -1, 0, 0, sorted(base)
    reach = list(accumulate((e for _, e, _ in base), max))
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if b - a < MIN_NOVEL:
            continue
        while i < len(near) and near[i][1] < a - AROUND:
            i += 1
        goes_on = 0 <= last and a - last <= 8 and text[last:a].isspace()
        if not goes_on and (i == len(near) or near[i][0] > b + AROUND):
            continue
        # NAME=value is one run: what follows the name is the key, if it is long enough.
        k = i
        while k < len(near) and near[k][1] < b:
            at = text.find("=", near[k][1], b) + 1 if near[k][0] >= a else 0
            if at and b - at >= MIN_NOVEL:
                a = at
                break
            k += 1
        while j < len(base) and reach[j] <= a:
            j += 1
        if j < len(base) and base[j][0] < b:
            continue
        if not any(map(str.isalpha, text[a:b])):
            continue
        parts = _novel_parts(text, a, b, bits, identifiers)
        if parts:
            found += [(x, y, "novel") for x, y in parts]
            last = parts[-1][1]
    return found


def spans_of(text: str | None, bits: float = BITS, identifiers: bytes = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """All spans by start, then by the order of KINDS."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    base = base_spans(text, raw)
    return sorted(base + novel_spans(text, raw, base, bits, identifiers), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()} REMOVED]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def names_near(text: str) -> set[str]:
    """Names made of words in the neighbourhood of sensitive words."""
    raw = text.encode("utf-8", "replace").lower()
    if not any(k in raw for k in _SENSITIVE_BYTES):
        return set()
    found: set[str] = set()
    at = 0
    for m in SENSITIVE.finditer(text):
        a, b = max(at, m.start() - AROUND), m.end() + AROUND
        found.update(x.strip(".-") for x in NAME.findall(text, a, b))
        at = max(at, m.start())
    return {x for x in found if len(x) >= 6 and wordlike(x)}


def corpus_identifiers(docs: DataFrame, text_col: str = "text", most: int = CORPUS_NAMES) -> bytes:
    """A dictionary for the compressor: the fixed identifiers, and the names that most documents have near sensitive words.

    Every document is counted, once a name; a task sends the counts of its own names, and only the most frequent ones reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("secret_scan")
        for batch in batches:
            counts = Counter(x for t in batch.column(0).to_pylist() if t for x in names_near(t))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["name", "n"])

    totals = docs.select(text_col).mapInArrow(run, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    names = [r.name for r in totals.orderBy(F.desc("n"), "name").limit(most).collect()]
    # The compressor reaches what stands last at the least cost.
    return " ".join(reversed(names)).encode() + b" " + IDENTIFIERS


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, clean_text string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: float = BITS, redact: bool = False, identifiers: bytes = IDENTIFIERS) -> DataFrame:
    """Spans of every row's whole text; with redact also the text without them (null where the text is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("secret_scan")
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                spans = spans_of(text, bits, identifiers)
                base = [s for s in spans if s[2] != "novel"]
                row = (*(sum(s[2] == k for s in spans) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redacted(text, spans) if redact and text is not None else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", bits: float = BITS, identifiers: bytes = IDENTIFIERS) -> DataFrame:
    """docs with every secret replaced in its text; the count of characters follows where a text changed. Other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("secret_scan")
        for batch in batches:
            texts, at = batch.column(text_col).to_pylist(), batch.schema.get_field_index(text_col)
            clean = [t if not t or not (s := spans_of(t, bits, identifiers)) else redacted(t, s) for t in texts]
            cols = list(batch.columns)
            cols[at] = pa.array(clean, batch.schema.field(at).type)
            if (k := batch.schema.get_field_index(chars_col)) >= 0:
                counts = [n if c == t else len(c) for n, c, t in zip(cols[k].to_pylist(), clean, texts, strict=True)]
                cols[k] = pa.array(counts, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
