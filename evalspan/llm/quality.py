"""Per-document text statistics, and documents that mostly aren't prose.

A text is cut into chunks of bounded length. Each chunk gives sums over its whole lines and two open lines at its
ends, which carry counts, the beginnings needed to tell a line's kind, and the words cut by the boundary. Two
neighbouring chunks are joined by closing the line between them; that operation is associative, so the chunks of a
huge document are joined in a tree, a bounded number at each node. Ratios and rules come last.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Workspace

#: Characters in a chunk, and chunks joined at one node of the tree.
CHUNK, FAN = 16_384, 32
#: Characters kept of a line's beginning (with and without its indent), and of a word cut by a chunk's end.
HEAD, TAIL = 40, 64
INDENT = "\ufeff \t\u00a0"
#: Different words remembered per text, to tell endless repetition.
FEW_WORDS = 24

WORD = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)*")
ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")
CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
TOKEN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W\d_]+")
DIGIT = re.compile(r"\d")
SYMBOL = re.compile(r"[^\w\s]|_")
ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffd\u2580-\u259f]")
# the first look keeps the pattern from being tried at every character
STOP = re.compile(r"(?=[.!?;\u3002\uff01\uff1f\uff1b])[.!?;\u3002\uff01\uff1f\uff1b]*(?:[.!?](?=[\s\"'\u201d)\]`]|$)|[\u3002\uff01\uff1f\uff1b]|(?<!\d);+)")
TRAIL = re.compile(r"\s[\u00bb\u203a\u2192>]\s")
CELL = re.compile(r"(?<!<)\|(?!>)|[\u2502\u2503\t]|</?t[dhr]\b|(?<=[^\s.!?:;,]) {2,}(?=\S)")
TIGHT_COMMA = re.compile(r",(?:(?=[^\s])|$)")
LONG = re.compile(r"[^\s\u2e80-\uffff]{48,}")
ENDED = re.compile(r"[.!?:;,\u3002\uff01\uff1f\u2026\"'\u201d)\]]$")
BULLET = re.compile(
    r"(?:[-*+\u2022\u00b7\u25e6\u2023\u2013\u2014\u25aa\u25cf\u25cb\u2219]|\[[ xX]\]|\(?\d{1,3}[.)\u3001]|\(?[A-Za-z][.)])\s+"
    r"|[A-Za-z]\w*_\w+\s*[:=]\s"
)
LOG = re.compile(
    r"\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d{2}:\d{2}:\d{2}\b|\d{3,}\s+\w+\[\d+\]|[0-9a-f]{8}\s{1,2}(?:[0-9a-f]{2}\s){2}|\[?(?:DEBUG|INFO|WARN|WARNING|ERROR)\b"
)
CODE = re.compile(
    r"(?:from|import) [.\w]+|(?:return|raise|assert)\b|(?:pass|break|continue)$|(?:try|else|finally):$"
    r"|[A-Za-z_][A-Za-z0-9_.\[\]\"', ]*\s*[-+*/|&%]?=(?!=)\s*\S|[A-Za-z_][A-Za-z0-9_.]*\([^)]*\)?;?$|[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_]+\("
    r"|Traceback|File \"|[A-Za-z]*(?:Error|Exception)\b:?|[}\])]+[,;]?$|\"\"\"|\'\'\'|#\s|self\.|@[A-Za-z_]",
    re.I,
)
#: Openers of a block, which is code if the line ends in a colon.
BLOCK = re.compile(r"(?:async\s+)?(?:def|class|try|except|finally|elif|else|while|for|if|with)\b", re.I)

KINDS = ("text", "list", "table", "code", "log", "junk")


@dataclass
class Line:
    """Counts of (a part of) one line, what its kind depends on at its beginning, and the words at its ends."""

    head: str = ""
    tail: str = ""
    chars: int = 0
    words: int = 0
    letters: int = 0
    common: int = 0
    cjk: int = 0
    digits: int = 0
    symbols: int = 0
    odd: int = 0
    stops: int = 0
    cells: int = 0
    trails: int = 0
    commas: int = 0
    long: int = 0
    start: str = ""


@dataclass
class Doc:
    """Sums over whole lines; ``seen`` holds the first different words."""

    lines: int = 0
    ended: int = 0
    chars: int = 0
    words: int = 0
    letters: int = 0
    common: int = 0
    cjk: int = 0
    digits: int = 0
    symbols: int = 0
    text_units: float = 0.0
    text_parts: int = 0
    kind_chars: list = field(default_factory=lambda: [0] * len(KINDS))
    seen: list = field(default_factory=list)


_DIGITS = b"0123456789"
_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum() and not chr(c).isspace())
_LETTERS = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else 32 for c in range(256))
_CONTROLS = bytes(c for c in range(32) if c not in (9, 10, 13))


def read_line(part: str, common: frozenset) -> Line:
    """The counts of a line or of a part of one."""
    tokens = part.split()
    if not tokens:
        return Line(part[:HEAD], part[-TAIL:], start=part.lstrip(INDENT)[:HEAD])
    cjk = digits = symbols = odd = 0
    if part.isascii():
        raw = part.encode()
        words = ASCII_WORD.findall(part.lower()) if "'" in part else raw.translate(_LETTERS).decode().split()
        digits = len(raw) - len(raw.translate(None, _DIGITS))
        symbols = len(raw) - len(raw.translate(None, _SIGNS))
        odd = len(raw) - len(raw.translate(None, _CONTROLS))
        known = sum(map(common.__contains__, words))
    else:
        words = WORD.findall(part.lower())
        signs = CJK.findall(part)
        cjk = len(signs)
        digits, symbols, odd = len(DIGIT.findall(part)), len(SYMBOL.findall(part)), len(ODD.findall(part))
        known = sum(map(common.__contains__, words)) + sum(map(common.__contains__, signs))
    cells = "|" in part or "\t" in part or "  " in part or "\u2502" in part or "\u2503" in part or "<t" in part or "</t" in part
    return Line(
        part[:HEAD], part[-TAIL:], sum(map(len, tokens)), len(words), sum(map(len, words)), known, cjk, digits, symbols, odd,
        len(STOP.findall(part)) if not part.isascii() or "." in part or ";" in part or "!" in part or "?" in part else 0,
        len(CELL.findall(part)) if cells else 0,
        len(TRAIL.findall(part)) if "\u00bb" in part or "\u203a" in part or "\u2192" in part or " > " in part else 0,
        len(TIGHT_COMMA.findall(part)) if "," in part else 0,
        sum(len(x) for x in LONG.findall(part)) if max(map(len, tokens)) >= 48 else 0,
        part.lstrip(INDENT)[:HEAD],
    )


def join_lines(a: Line, b: Line, common: frozenset) -> Line:
    """Two neighbouring parts of one line. What the boundary cut is corrected by reading the last word of one with
    the first of the other, up to TAIL and HEAD characters of them."""
    if not a.tail and not a.head:
        return b
    if not b.tail and not b.head:
        return a
    x, y = re.search(r"\S*\s*$", a.tail)[0], re.match(r"\s*\S*", b.head)[0]
    both, one, two = read_line(x + y, common), read_line(x, common), read_line(y, common)
    sums = {
        f.name: getattr(a, f.name) + getattr(b, f.name) + getattr(both, f.name) - getattr(one, f.name) - getattr(two, f.name)
        for f in fields(Line) if f.name not in ("head", "tail", "start")
    }
    start = (a.start + b.head)[:HEAD] if a.start else b.start
    return Line((a.head + b.head)[:HEAD] if len(a.head) < HEAD else a.head, (a.tail + b.tail)[-TAIL:], start=start, **sums)


def kind_of(line: Line) -> str:
    """The kind of a whole line from its counts and its beginning."""
    head = line.start
    while head.startswith(">"):
        head = head[1:].lstrip()
    units = line.words + 0.6 * line.cjk
    n = max(line.chars, 1)
    if line.odd > 0.05 * n or line.long > 0.5 * n or (n >= 8 and line.letters + line.digits < 0.4 * n and line.cells < 2):
        return "junk"
    if LOG.match(head):
        return "log"
    if line.cells >= 2 and units < 9 * (line.cells + 1):
        return "table"
    end = line.tail.rstrip()
    sentence = units >= 8 and line.stops >= 1 and end[-1:] in ".!?" and line.common >= 0.1 * units
    if len(line.start) == HEAD:
        head += "\u2026"  # there is more
    if not sentence and line.cjk < 4:
        if BLOCK.match(head) and end.endswith(":") or (CODE.match(head) and line.common < 0.34 * max(units, 1)):
            return "code"
    if BULLET.match(head) or (line.trails >= 3 and units < 5 * line.trails):
        return "list"
    if line.commas >= 2 and units < (4 if line.cjk >= 4 else 6) * (line.commas + 1):
        return "table"
    if line.digits > 0.5 * n:
        return "table"
    return "text"


def add_line(doc: Doc, line: Line) -> None:
    """Close a line: its counts go into the sums, its characters to its kind."""
    if not line.chars:
        return
    doc.lines += 1
    doc.ended += bool(ENDED.search(line.tail.rstrip()))
    doc.chars += line.chars
    doc.words += line.words
    doc.letters += line.letters
    doc.common += line.common
    doc.cjk += line.cjk
    doc.digits += line.digits
    doc.symbols += line.symbols
    kind = kind_of(line)
    doc.kind_chars[KINDS.index(kind)] += line.chars
    if kind == "text":
        doc.text_units += line.words + 0.6 * line.cjk
        doc.text_parts += max(1, line.stops)


def read_text(text: str, common: frozenset) -> tuple[Doc, Line, Line | None]:
    """Sums, the open line on the left and the one on the right (None if the chunk holds no line end)."""
    parts = re.split(r"\r\n?|\n|\u2028|\u2029|\x85", text)
    doc = Doc()
    for part in parts[1:-1]:
        if part:
            add_line(doc, read_line(part, common))
    seen: dict = {}
    for w in TOKEN.finditer(text):
        seen[w[0].lower()] = 1
        if len(seen) > FEW_WORDS:
            break
    doc.seen = list(seen)
    left = read_line(parts[0], common)
    return doc, left, read_line(parts[-1], common) if len(parts) > 1 else None


State = tuple[Doc, Line, "Line | None"]


def join_states(a: State, b: State, common: frozenset) -> State:
    """The state of two neighbouring chunks; associative."""
    total = Doc()
    for f in fields(Doc):
        if f.name not in ("kind_chars", "seen"):
            setattr(total, f.name, getattr(a[0], f.name) + getattr(b[0], f.name))
    total.kind_chars = [x + y for x, y in zip(a[0].kind_chars, b[0].kind_chars)]
    total.seen = list(dict.fromkeys([*a[0].seen, *b[0].seen]))[: FEW_WORDS + 1]
    if a[2] is None:
        return total, join_lines(a[1], b[1], common), b[2]
    middle = join_lines(a[2], b[1], common)
    if b[2] is None:
        return total, a[1], middle
    add_line(total, middle)
    return total, a[1], b[2]


def finish(state: State) -> Doc:
    """Close the two outer lines."""
    doc, left, right = state
    add_line(doc, left)
    if right is not None:
        add_line(doc, right)
    return doc


def shares(doc: Doc) -> dict:
    """Ratios and the outcome of the rules for a finished document."""
    kinds = dict(zip(KINDS, doc.kind_chars))
    average = doc.text_units / doc.text_parts if doc.text_parts else 0.0
    fragments = doc.text_parts >= 3 and average < 6  # a sentence has more words than an entry
    endless = average > (80 if doc.cjk > 0.2 * doc.chars else 40)
    repeated = len(doc.seen) <= FEW_WORDS and 4 * len(doc.seen) <= doc.words + doc.cjk
    # no sentence end and none of the words that every sentence has
    wordy = doc.words >= 20 and not doc.ended and doc.common < 0.03 * doc.words and doc.cjk < 4
    if fragments or endless or repeated or wordy:
        other = "list" if fragments else "junk"
        kinds[other], kinds["text"] = kinds[other] + kinds["text"], 0
    n = max(doc.chars, 1)
    return {
        "chars": doc.chars, "lines": doc.lines, "words": doc.words + doc.cjk,
        "mean_word_length": round((doc.letters - doc.cjk) / max(doc.words, 1), 6),
        "symbol_ratio": round(doc.symbols / n, 6), "digit_ratio": round(doc.digits / n, 6),
        "ended_line_share": round(doc.ended / max(doc.lines, 1), 6),
        "common_share": round(doc.common / max(doc.words + doc.cjk, 1), 6),
        "sentence_words": round(average, 6), "prose_share": round(kinds["text"] / n, 6),
        "kind": max(KINDS, key=lambda k: kinds[k]) if doc.chars else None,
    }


STATS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("chars", "lines", "words")]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("mean_word_length", "symbol_ratio", "digit_ratio", "ended_line_share", "common_share", "sentence_words", "prose_share")
    ]
    + [T.StructField("kind", T.StringType())]
)


def pack(state: State) -> bytes:
    return pickle.dumps(tuple(None if x is None else astuple(x) for x in state))


def unpack(data: bytes) -> State:
    doc, left, right = pickle.loads(data)
    return Doc(*doc), Line(*left), None if right is None else Line(*right)


def cut_text(text: str, size: int = CHUNK) -> Iterator[str]:
    """Consecutive pieces of at most ``size`` characters, cut at a blank where one is near."""
    at = 0
    while len(text) - at > size:
        end = at + size
        for back in range(min(256, size // 2)):
            if text[end - 1 - back].isspace():
                end -= back
                break
        yield text[at:end]
        at = end
    yield text[at:]


def text_statistics(df: DataFrame, key: str, text: str, common_words: DataFrame, work: Workspace, chunk: int = CHUNK) -> DataFrame:
    """``key`` and the statistics of each text; counts of 0 and no kind for empty and blank texts; null texts are left out.

    ``common_words`` has a column ``word`` (100,000 rows at most, checked). Keys should be unique: texts of one key
    that are longer than a chunk are taken for one. Texts no longer than a chunk are finished where they are read;
    longer ones are spread over tasks by chunk and joined in a tree. Other columns are ignored.
    """
    if key in STATS.names:
        raise ValueError(f"a key named {key} would clash with a statistic")
    words = [r[0] for r in common_words.where("word is not null").select(F.lower("word")).distinct().limit(100_001).collect()]
    if len(words) > 100_000:
        raise ValueError("too many common words")
    common = frozenset(words)
    id_field = T.StructField(key, df.schema[key].dataType)
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([shares(finish(read_text(t, common))) for t in f["_text"]], columns=STATS.names)
            out.insert(0, key, f[key])
            yield out

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, t in zip(f[key], f["_text"]):
                parts = list(cut_text(t, chunk))
                yield pd.DataFrame({key: [k] * len(parts), "_k": range(len(parts)), "_part": parts})

    def states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "_k": f["_k"], "_state": [pack(read_text(t, common)) for t in f["_part"]]})

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_k")
        state = None
        for data in f["_state"]:
            state = unpack(data) if state is None else join_states(state, unpack(data), common)
        return pd.DataFrame({key: f[key].iloc[:1].values, "_k": [f["_k"].iloc[0] // FAN], "_state": [pack(state)]})

    def end(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([shares(finish(unpack(s))) for s in f["_state"]], columns=STATS.names)
            out.insert(0, key, f[key].values)
            yield out

    out_schema = T.StructType([id_field, *STATS.fields])
    piece_schema = T.StructType([id_field, T.StructField("_k", T.LongType()), T.StructField("_part", T.StringType())])
    state_schema = T.StructType([id_field, T.StructField("_k", T.LongType()), T.StructField("_state", T.BinaryType())])
    short = rows.where(F.length("_text") <= chunk).mapInPandas(whole, out_schema)
    parts = rows.where(F.length("_text") > chunk).mapInPandas(pieces, piece_schema).repartition(key, "_k")
    level, name = work.write(parts.mapInPandas(states, state_schema), "level0"), 0
    most = level.agg(F.max("_k")).first()[0] or 0
    while most > 0:
        name += 1
        joined = level.groupBy(key, F.floor(F.col("_k") / FAN).alias("_g")).applyInPandas(join, state_schema)
        level = work.write(joined, f"level{name}")
        most //= FAN
    return short.unionByName(level.mapInPandas(end, out_schema))
