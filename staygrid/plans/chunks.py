"""Splitting documents: overlapping chunks, boundary chunks, Markdown spans.

``register_table_functions`` makes the two splitters callable in SQL, with LATERAL.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_id, strip
from ..session import spread

MAX_CHARS = 28_000
MAX_BYTES = 95_000


def overlapping(docs: DataFrame, keys: list[str], body: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Fixed-size chunks that share ``overlap`` characters; blank ones dropped.

    One regex pass: the lookahead takes a whole chunk, the match itself only
    advances by the step.  Numbers are given after blanks are dropped.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    pattern = rf"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}"
    pieces = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda c: strip(c))
    kept = F.filter(pieces, lambda c: c != "")
    return spread(docs, *keys).select(*keys, F.posexplode(kept).alias("chunk_no", "content"))


def ingest(docs: DataFrame, source: str, body: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunk rows with their stable id (id, source, chunk_no, content)."""
    rows = overlapping(docs, [source], body, size, overlap)
    return rows.select(chunk_id(F.col(source), F.col("chunk_no")).alias("id"), F.col(source).alias("source"), "chunk_no", "content")


def _cut(text: str, start: int, limit: int) -> int:
    """Best end in the upper half of a window: paragraph, line, sentence, blank, else the limit."""
    low = start + limit // 2
    high = start + limit
    for mark in ("\n\n", "\n"):
        at = text.rfind(mark, low, high)
        if at > low:
            return at + len(mark)
    ends = [m.end() for m in re.finditer(r"[.!?]\s", text[low:high])]
    if ends:
        return low + ends[-1]
    at = text.rfind(" ", low, high)
    return at + 1 if at > low else high


def boundary_pieces(text: str, max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES) -> list[tuple[int, str]]:
    """(start, piece) whose concatenation is the text; a small per-document helper."""
    out, start = [], 0
    while start < len(text):
        end = len(text) if start + max_chars >= len(text) else _cut(text, start, max_chars)
        piece = text[start:end]
        raw = piece.encode("utf-8", "surrogatepass")
        if len(raw) > max_bytes:
            piece = raw[:max_bytes].decode("utf-8", "ignore") or piece[:1]
        out.append((start, piece))
        start += len(piece)
    return out


def at_boundaries(
    docs: DataFrame, keys: list[str], body: str, max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES, dealt: bool = False,
) -> DataFrame:
    """Non-overlapping chunks cut at natural boundaries (keys, chunk_no, start, content).

    ``dealt``: the rows are on all cores already, and texts that were made since then are not shuffled.
    """
    if max_chars <= 0 or max_bytes <= 0:
        raise ValueError("max_chars and max_bytes must be positive")
    if max_bytes < 4:
        raise ValueError("max_bytes must hold one character")

    @F.pandas_udf("array<struct<start:int,content:string>>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda v: [{"start": a, "content": p} for a, p in boundary_pieces(v, max_chars, max_bytes)], na_action="ignore")

    rows = (docs if dealt else spread(docs, *keys)).select(*keys, F.posexplode(split(body)).alias("chunk_no", "_c"))
    return rows.select(*keys, "chunk_no", "_c.start", "_c.content")


# ------------------------------------------------------------ markdown spans

_LINK = re.compile(r"(!?)\[([^\]]*)\]\(([^)\s]*)[^)]*\)")


def _inline(text: str) -> str:
    import html

    def link(m):
        if m[1]:
            return m[2]
        if re.fullmatch(r"\[?\w{1,3}\]?", m[2]) and "cite_note" in m[3]:
            return ""
        return f"[{m[2]}]({m[3]})"

    text = _LINK.sub(link, text)
    text = re.sub(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?!\w)|`([^`]+)`", lambda m: m[1] or m[2], text)
    return html.unescape(text)


def _cells(line: str) -> str:
    cells = [_inline(c).strip() for c in line.strip().strip("|").split("|")]
    return " | ".join(c for c in cells if c)


def markdown_spans(markdown: str) -> list[dict]:
    """Candidate spans of a Markdown text; a small per-document helper.

    Headings, sentences, table rows and code lines, numbered by block.
    """
    spans: list[dict] = []
    block = -1

    def add(kind, text, lang=None, header=False):
        if text:
            spans.append({"block": block, "kind": kind, "text": text, "lang": lang, "is_header": header})

    def sentences(lines):
        joined = " ".join(_inline(" ".join(lines)).split())
        for part in re.split(r"(?<=[.!?])\s+", joined):
            add("text", part.strip())

    lines = markdown.split("\n")
    i = 0
    while i < len(lines):
        line = re.sub(r"^\s*(>\s?)+", "", lines[i])
        fence = re.match(r"\s*```(\S*)", line)
        head = re.match(r"#{1,6}\s+(.*?)\s*#*$", line)
        if not line.strip() or re.fullmatch(r"\s*([-*_]\s*){3,}", line):
            i += 1
            continue
        block += 1
        if fence:
            i += 1
            while i < len(lines) and not lines[i].lstrip().startswith("```"):
                add("code", lines[i].strip(), fence[1] or None)
                i += 1
            i += 1
        elif head:
            add("heading", _inline(head[1]).strip())
            i += 1
        elif "|" in line and i + 1 < len(lines) and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", lines[i + 1]):
            add("table", _cells(line), header=True)
            i += 2
            while i < len(lines) and "|" in lines[i]:
                add("table", _cells(lines[i]))
                i += 1
        else:
            item = re.match(r"\s*([-*+]|\d+[.)])\s+", line)
            para = [line[item.end():] if item else line]
            i += 1
            while i < len(lines) and lines[i].strip() and not re.match(r"\s*(```|#{1,6}\s|[-*+]\s|\d+[.)]\s)", lines[i]):
                para.append(re.sub(r"^\s*(>\s?)+", "", lines[i]))
                i += 1
            sentences(para)
    return spans


def spans_of(docs: DataFrame, keys: list[str], body: str) -> DataFrame:
    """Span rows (keys, pos, block, kind, text, lang, is_header)."""

    @F.pandas_udf("array<struct<block:int,kind:string,text:string,lang:string,is_header:boolean>>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(markdown_spans, na_action="ignore")

    rows = spread(docs, *keys).select(*keys, F.posexplode(split(body)).alias("pos", "_s"))
    return rows.select(*keys, "pos", "_s.block", "_s.kind", "_s.text", "_s.lang", "_s.is_header")


def assembled(spans: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Readable text from the chosen (keys, pos) spans.

    A chosen table row brings its header, code lines get their fence back, text
    spans of one block become one paragraph.  A group is one document's block.
    """
    # Joined by document, so that one shuffle of the spans serves the join and both groupings: 64 places a bit set.
    marks = chosen.select(*keys, F.floor(F.col("pos") / 64).cast("int").alias("_slot"), F.expr("shiftleft(1L, cast(pmod(pos, 64) as int))").alias("_bit"))
    slots = marks.groupBy(*keys, "_slot").agg(F.bit_or("_bit").alias("_bits")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_slot", "_bits"))).alias("_marks"))
    slot = F.try_element_at("_marks", F.floor(F.col("pos") / 64).cast("int"))
    bit = slot.bitwiseAND(F.expr("shiftleft(1L, cast(pmod(pos, 64) as int))")) != 0
    tagged = spans.join(slots, keys, "left").withColumn("_chosen", F.coalesce(bit, F.lit(False))).drop("_marks")
    cells = F.split("text", r" \| ")
    header = F.concat(
        F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("*"), F.lit("\\*"))), " | "), F.lit(" |\n| "),
        F.array_join(F.transform(cells, lambda c: F.lit("---")), " | "), F.lit(" |"))
    line = F.when(F.col("kind") != "table", F.col("text")).when(F.col("is_header"), header).otherwise(
        F.concat(F.lit("| "), "text", F.lit(" |")))
    picked = F.col("_chosen")
    entry = F.struct("pos", line.alias("line"))
    # A header joins when it was chosen or any row of its table was.
    wanted = F.when(picked | F.col("is_header"), entry)
    grouped = tagged.groupBy(*keys, "block", "kind").agg(
        F.bool_or(picked).alias("_any"), F.first("lang", True).alias("lang"), F.sort_array(F.collect_list(wanted)).alias("_lines"))
    parts = grouped.filter("_any").select(
        *keys, "kind", "lang", F.col("_lines")[0]["pos"].alias("at"), F.transform("_lines", lambda e: e["line"]).alias("lines"))
    text = F.when(F.col("kind") == "code", F.concat(
        F.lit("```"), F.coalesce("lang", F.lit("")), F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n```"))
    ).when(F.col("kind") == "table", F.array_join("lines", "\n")).otherwise(F.array_join("lines", " "))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", text.alias("text")))), lambda e: e["text"])
    return parts.groupBy(*keys).agg(F.array_join(ordered, "\n\n").alias("answer"))


# ------------------------------------------------------------ table functions

def _check_limits(max_chars: int, max_bytes: int) -> None:
    if max_chars is None or max_bytes is None or max_chars <= 0 or max_bytes < 4:
        raise ValueError("max_chars must be positive, max_bytes must hold one character")


class _ChunkMarkdown:
    def eval(self, body: str, max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES):
        _check_limits(max_chars, max_bytes)
        for no, (start, piece) in enumerate(boundary_pieces(body or "", max_chars, max_bytes)):
            yield no, start, piece


class _MarkdownSpans:
    def eval(self, body: str):
        for pos, s in enumerate(markdown_spans(body or "")):
            yield pos, s["block"], s["kind"], s["text"], s["lang"], s["is_header"]


chunk_markdown = F.udtf(_ChunkMarkdown, returnType="chunk_no int, start int, content string", useArrow=True)
# Not in Arrow: a batch of it is 10,000 texts with all their rows, here it is 100 texts.
md_spans = F.udtf(_MarkdownSpans, returnType="pos int, block int, kind string, text string, lang string, is_header boolean", useArrow=False)


def register_table_functions(spark: SparkSession) -> None:
    """``chunk_markdown(text[, max_chars, max_bytes])`` and ``md_spans(text)`` for this session's SQL.

    Rows of the first are those of ``at_boundaries``, rows of the second those of ``spans_of``.  NULL and empty texts
    give no row; Spark evaluates table functions without outer rows, so LEFT JOIN LATERAL drops their documents too.
    """
    spark.udtf.register("chunk_markdown", chunk_markdown)
    spark.udtf.register("md_spans", md_spans)
