"""Texts that were cut before their end.

A stack automaton reads each whole text and keeps open code fences, strings, quotes, brackets and markup; its state at the end, the
kind of the last line and broken characters tell how the text ends. What counts as a whole end is measured per source,
copies of a text counting once: whether the texts whose end isn't in doubt usually end in a closing statement, which
unfinished-looking endings are common to many texts, and at which length in characters, bytes or tokens the texts pile
up. A text is cut if its end is open, if it sits at such a limit in mid-code, or if it sits there (or was far longer in
generated tokens) and its last word can't be whole.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Workspace

#: What is put in the place of a lost end: dots or a bracketed note.
MARKER = re.compile(r"(?:\.\.\.|\u2026|<[A-Za-z .\u2026]{0,40}>|\[[A-Za-z .\u2026]{0,40}\])$")
#: A bracketed word is a marker only with one of these stems (or none but dots); else it may be an index.
MARKER_WORD = re.compile(r"cut|trunc|snip|omit|more|cont|elid|^[\W_]*$", re.I)
TERMINAL = re.compile(r"(?:return|raise|pass|continue|break)\b|\.\.\.$", re.I)
STATEMENT = re.compile(
    r"(?:return|if|elif|else|for|while|try|except|finally|with|def|class|import|from|raise|assert|pass)\b"
    r"|[A-Za-z_][\w.\[\]]*\s*(?:[-+*/]?=(?!=)|,)",
    re.I,
)
# Elements of HTML that hold text. Only their tags count, so that a comparison is no tag.
ELEMENTS = (
    "a|abbr|article|b|blockquote|body|button|caption|code|dd|details|div|dl|dt|em|figure|footer|form|h[1-6]|head|header|html|i|label|li|main|nav|ol"
    "|option|p|pre|script|section|select|small|span|strong|style|sub|summary|sup|svg|table|tbody|td|textarea|tfoot|th|thead|title|tr|u|ul"
)
_TAG = rf"<(?:/(?:{ELEMENTS})|(?:{ELEMENTS})(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"']+))*)\s*>"
OPEN_TAG = re.compile(rf"</?(?:{ELEMENTS})(?:\s+[\w:-]+\s*=[^<>]*)?$")
STRUCTURE = re.compile(rf"\\.|{_TAG}|\"\"\"|'''|[\"'()\[\]{{}}#\n\u201c\u201d\u201e]")
#: An escape, or a character in bytes of UTF-8 read as Latin-1, that isn't finished.
BROKEN = re.compile(
    r"\ufffd$|[\ud800-\udfff]$|(?<!\\)(?:\\\\)*\\(?:x[0-9A-Fa-f]?|u[0-9A-Fa-f]{0,3}|U[0-9A-Fa-f]{0,7}|N\{[^}\n]*)?$"
)
LEAD, PAIR = re.compile(r"(?:[\u00c2-\u00df]|[\u00e0-\u00ef][\u0080-\u00bf]?|[\u00f0-\u00f4][\u0080-\u00bf]{0,2})$"), re.compile(r"[\u00c2-\u00df][\u0080-\u00bf]")
CLOSES = {")": "(", "]": "[", "}": "{"}
SENTENCE_END = re.compile(r"[.!?:;\u3002\uff01\uff1f)\"'`*\]]$")
#: A share of a source's texts at one length that counts as a limit of that source.
PILE_SHARE = 0.01
#: A share of a source's unfinished-looking last sentences from which an ending counts as usual, and the number of texts
#: at which these weigh as much as those of the other sources: two texts alone (2 of 42) are below the share.
ENDING_SHARE, ENDING_WEIGHT = 0.05, 40

END_SCHEMA = T.StructType(
    [T.StructField("kind", T.StringType())]
    + [T.StructField(c, T.BooleanType()) for c in ("marker", "fence", "quote", "markup")]
    + [T.StructField("depth", T.IntegerType())]
    + [T.StructField(c, T.BooleanType()) for c in ("broken", "inner", "terminated")]
    + [T.StructField("ending", T.StringType()), T.StructField("known", T.BooleanType())]
)


def end_state(text: str) -> tuple:
    """The automaton's state after the whole text, in the order of ``END_SCHEMA``."""
    body = text.rstrip()
    last = body.rsplit("\n", 1)[-1]
    found = MARKER.search(body)
    marker = bool(found and last.strip() != "..." and MARKER_WORD.search(found[0][1:-1] if found[0][0] in "[<" else ""))
    broken = bool(BROKEN.search(last)) or bool(LEAD.search(last) and PAIR.search(body[:-3]))
    if marker:
        body = body[: found.start()].rstrip()
        last = body.rsplit("\n", 1)[-1]
    fenced = "```" in body
    fence, quote, stack, comment, at = False, "", [], False, 0
    tags, said = [], 0  # open elements, and typographic quotes open in the line
    line = body.split("\n", 1)[0]
    fence = line.lstrip().startswith("```")
    for m in STRUCTURE.finditer(body):
        c = m[0]
        if c == "\n":
            comment, said = False, 0
            at = m.end()
            end = body.find("\n", at)
            line = body[at : end if end >= 0 else len(body)]
            if len(quote) < 3:
                quote = ""  # a string of one line ends with it, closed or not
            if not quote:
                if line.lstrip().startswith("```"):
                    fence, stack = not fence, []
                elif stack and STATEMENT.match(line.lstrip()):
                    stack = []  # broken syntax further up isn't an open end
        elif comment or (fenced and not fence):
            continue
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\u201c\u201d\u201e":
            said = max(0, said - 1) if c == "\u201d" or (c == "\u201c" and said) else said + 1
        elif c == "#":
            comment = True
        elif c[0] == "<":
            name = re.match(r"</?(\w+)", c)[1].lower()
            if c[1] != "/":
                tags.append(name)
            elif name in tags:
                del tags[len(tags) - 1 - tags[::-1].index(name) :]
        elif c[0] in "\"'":
            quote = c
        elif c in "([{":
            stack.append(c)
        elif c in CLOSES and stack and stack[-1] == CLOSES[c]:
            stack.pop()
    bare = last.strip()
    indent = len(last) - len(last.lstrip())
    least = min((len(x) - len(x.lstrip()) for x in body.split("\n") if x.strip() and "```" not in x), default=0)
    if bare.startswith("```"):
        kind = "fence"
    elif TERMINAL.match(bare):
        kind = "terminal"
    elif (fenced and not fence) or bare.startswith("#") or (
        re.match(r"[^\W\d_]", bare) and bare[0].isupper() and len(bare.split()) > 1 and not re.search(r"[=(\[{]", bare.split(".")[0])
    ):
        kind = "sentence"
    else:
        kind = "other"
    words = re.findall(r"\w+", bare)
    known = True
    if kind == "terminal":
        name = re.fullmatch(r"(?:return|raise)\s*([A-Za-z_]\w*)?;?", bare, re.I)
        if name:
            known = bool(name[1]) and bool(re.search(rf"\b{re.escape(name[1])}\b", body[: len(body) - len(last)]))
            known = known or (name[1] or "").lower() in ("none", "true", "false", "self")
    return (
        kind, marker, fence and kind != "fence" or (kind == "fence" and fence), bool(quote) and kind != "sentence" or said > 0,
        bool(tags) or not quote and bool(OPEN_TAG.search(last)),
        0 if kind == "sentence" else len(stack), broken, kind == "terminal" and indent > least,
        bool(SENTENCE_END.search(bare)), " ".join(words[-2:]).lower(), known,
    )


@F.pandas_udf(END_SCHEMA)
def end_states(texts: pd.Series) -> pd.DataFrame:
    """``end_state`` of each text; nulls for null and for blank texts."""
    columns = END_SCHEMA.names
    return pd.DataFrame([end_state(t) if t and t.strip() else (None,) * len(columns) for t in texts], columns=columns)


def _limits(texts: DataFrame, size: str) -> DataFrame:
    """Per source the size at which its texts pile up, if any: at least ``PILE_SHARE`` of them (two at least), and more
    than five times as many as lie above. Copies of one text are no pile."""
    counts = texts.where(F.col(size).isNotNull()).groupBy("source", size).agg(F.count("*").alias("n"))
    every = Window.partitionBy("source")
    above = every.orderBy(F.col(size).desc()).rowsBetween(Window.unboundedPreceding, -1)
    piles = counts.select(
        "source", size, "n", F.sum("n").over(every).alias("all"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("over")
    ).where((F.col("n") >= 2) & (F.col("n") >= PILE_SHARE * F.col("all")) & (F.col("n") > 5 * F.col("over")))
    return piles.groupBy("source").agg(F.max(size).alias(f"{size}_limit"))


def _high_ratios(texts: DataFrame, share: float = 0.95, step: float = 0.001, most: float = 100.0) -> DataFrame:
    """Per source the ratio of tokens to characters that ``share`` of its texts don't exceed, in steps of a fixed
    histogram: the same however the rows are spread. Ratios above ``most`` count as that."""
    cell = F.ceil(F.least("ratio", F.lit(most)) / step)
    counts = texts.where("ratio is not null").groupBy("source", cell.alias("cell")).agg(F.count("*").alias("n"))
    every = Window.partitionBy("source")  # at most most / step cells
    below = F.sum("n").over(every.orderBy("cell"))
    reached = counts.select("source", "cell", below.alias("below"), F.sum("n").over(every).alias("all")).where(F.col("below") >= share * F.col("all"))
    return texts.select("source").distinct().join(reached.groupBy("source").agg((F.min("cell") * step).alias("ratio95")), "source", "left")


def _suspects(rows: DataFrame, base: DataFrame) -> DataFrame:
    """``rows`` with ``limited`` (at a limit of their source) and ``suspect`` (also if far longer in generated tokens)."""
    limited = (
        F.coalesce(F.col("chars") >= F.col("chars_limit"), F.lit(False))
        | F.coalesce(F.col("bytes").between(F.col("bytes_limit") - 3, F.col("bytes_limit")), F.lit(False))
        | F.coalesce(F.col("tokens") >= F.col("tokens_limit"), F.lit(False))
    )
    longer = F.coalesce(F.col("ratio") > 1.05 * F.col("ratio95"), F.lit(False))
    return rows.join(base, "source", "left").withColumn("limited", limited).withColumn("suspect", F.col("limited") | longer)


def _usual_endings(loose: DataFrame) -> DataFrame:
    """``source, ending`` of the usual endings among texts with an unfinished-looking last sentence.

    An ending's share is measured over the different texts of its source. A source with few of them borrows up to
    ``ENDING_WEIGHT`` texts from the other sources, as far as there are any, with the ending's share there: so an ending
    needs the same evidence at every size, be it three texts of its own or many of others.
    """
    texts = loose.select("source", "text_id", "ending").distinct()
    own = texts.groupBy("source", "ending").agg(F.count("*").alias("n"))
    sizes = texts.groupBy("source").agg(F.count("*").alias("of"))
    # a text in several sources counts once, and as the source's own where it is one of them
    every = texts.groupBy("ending").agg(F.count_distinct("text_id").alias("all_n"))
    total = texts.agg(F.count_distinct("text_id").alias("all_of"))
    others = F.col("all_of") - F.col("of")
    borrowed = F.when(others > 0, F.least(others, F.lit(ENDING_WEIGHT)) * (F.col("all_n") - F.col("n")) / others).otherwise(0)
    counted = own.join(sizes, "source").join(every, "ending").join(F.broadcast(total), F.lit(True))  # the total is one row
    usual = counted.where(F.col("n") + borrowed >= ENDING_SHARE * (F.col("of") + ENDING_WEIGHT))
    return usual.select("source", "ending", F.lit(True).alias("usual"))


def find_truncated(
    df: DataFrame, key: str, text: str, source: str, tokens: str, work: Workspace
) -> DataFrame:
    """``key, source, reason`` of every row with a text; ``reason`` is null for whole texts.

    Sources are compared in lower case without outer blanks; a null source is a source of its own, null token counts
    tell nothing. Null, empty and blank texts are left out. Other columns are ignored.
    """
    name = F.coalesce(F.lower(F.trim(source)), F.lit("\u0000none"))
    rows = (
        df.where(F.col(text).isNotNull() & (F.trim(text) != ""))
        .select(F.col(key).alias("_key"), name.alias("source"), F.col(text).alias("_t"), F.col(tokens).cast("long").alias("tokens"))
        .select(
            "_key", "source", "tokens", F.length("_t").cast("long").alias("chars"),
            F.octet_length("_t").cast("long").alias("bytes"), F.md5("_t").alias("text_id"), end_states("_t").alias("e"),
        )
        .select("_key", "source", "tokens", "chars", "bytes", "text_id", "e.*")
        .withColumn("ratio", F.col("tokens") / F.col("chars"))
    )
    rows = work.write(rows, "ends")
    # one row per text of a source, or more where its copies differ in tokens
    texts = work.write(rows.drop("_key").dropDuplicates(["source", "text_id", "tokens"]), "texts")
    base = _high_ratios(texts)
    for size in ("chars", "bytes", "tokens"):
        sized = texts if size == "tokens" else texts.dropDuplicates(["source", "text_id"])
        base = base.join(_limits(sized, size), "source", "left")
    open_end = F.col("marker") | F.col("broken") | F.col("fence") | F.col("quote") | F.col("markup") | (F.col("depth") > 0)
    ends = _suspects(texts, base).groupBy("source", "text_id").agg(
        F.first("kind").alias("kind"), F.bool_or(F.col("suspect") | open_end).alias("doubtful")
    )
    closing = ends.where("not doubtful").groupBy("source").agg(
        F.avg(F.col("kind").isin("terminal", "fence", "sentence").cast("double")).alias("closing")
    )
    usual = _usual_endings(texts.where("kind = 'sentence' and not terminated and not marker"))
    judged = (
        _suspects(rows, base)
        .join(closing, "source", "left")
        .join(usual, ["source", "ending"], "left")
    )
    unusual = (F.col("closing") >= 0.5) | F.col("limited")
    reason = (
        F.when(F.col("marker"), "marker")
        .when(F.col("broken"), "broken character or escape")
        .when(F.col("fence"), "open fence")
        .when(F.col("quote"), "open quote")
        .when(F.col("markup"), "open markup")
        .when(F.col("depth") > 0, "open bracket")
        .when((F.col("kind") == "sentence") & ~F.col("terminated") & F.col("usual").isNull(), "open sentence")
        .when((F.col("kind") == "other") & unusual, "no closing statement")
        .when(F.col("inner") & unusual, "inner statement")
        .when(F.col("suspect") & ~F.col("known"), "cut word at a limit")
    )
    return judged.select(F.col("_key").alias(key), F.when(F.col("source") != "\u0000none", F.col("source")).alias("source"), reason.alias("reason"))


def truncation_rates(found: DataFrame) -> DataFrame:
    """Per source the number of texts, of cut ones, and their share."""
    return found.groupBy("source").agg(
        F.count("*").alias("texts"), F.count("reason").alias("cut"), F.avg(F.col("reason").isNotNull().cast("double")).alias("cut_share")
    )
