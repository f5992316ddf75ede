"""Giant files cut into segments that many tasks work on, with the rows of the uncut file.

A giant file is cut into blocks of lines. Each block of a Go file is read from every state a line can begin in (in code, in a
block comment, in a raw string) and says in which state it ends, by how much the brackets are deeper, and where a declaration
begins at the start of a line. Put together block by block, these facts give the true state and depth at the start of
each block, and so the first declaration of a block that stands in code outside all brackets: there a new segment begins.
Nothing that the lexer or the token rules look at reaches over such a place. A comment or raw string without an end keeps the
rest of the file together, as how it is read depends on all of it. Files of other kinds are cut at blocks.

Only files with brackets that don't pair can differ, in what counts as a member of a declaration group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import catalog
from scanloom.functions.text import count_newlines
from scanloom.plans.staging import Staging, staging

#: Bytes from which a file is worth cutting, and blocks that such a file has at least.
GIANT_BYTES, BLOCKS = 16 << 20, 16

CODE, COMMENT, RAW = range(3)
_CLOSING = {COMMENT: "*/", RAW: "`"}
# What changes the state or the depth, tried in the order of the lexer; strings end on their line unless it is escaped.
_EVENT = re.compile(
    r"//[^\n]*|/\*|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|`|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|[()\[\]{}]|(?:func|var|const|type)(?![\w])", re.S
)
_DEEPER = {"(": (1, 0, 0), ")": (-1, 0, 0), "[": (0, 1, 0), "]": (0, -1, 0), "{": (0, 0, 1), "}": (0, 0, -1)}
#: A declaration may follow one of these, or a name; behind others its first word could belong to what precedes it.
_ENDS = set("})\"`'")


def block_facts(text: str, state: int) -> tuple[int, tuple[int, int, int], dict[tuple[int, int, int], int]]:
    """End state and change of depth of a block that begins in ``state``, and for each depth the first place in it where a
    declaration begins a line."""
    at, depth, places = 0, (0, 0, 0), {}
    while True:
        if state != CODE:
            end = text.find(_CLOSING[state], at)
            if end < 0:
                return state, depth, places
            at, state = end + len(_CLOSING[state]), CODE
        found = _EVENT.search(text, at)
        if not found:
            return state, depth, places
        event, at = found[0], found.end()
        if event in _DEEPER:
            depth = tuple(a + b for a, b in zip(depth, _DEEPER[event], strict=True))
        elif event == "/*":
            state = COMMENT
        elif event == "`":
            state = RAW
        elif event[0] in "fvct" and depth not in places and _follows_an_end(text, found.start()):
            places[depth] = found.start()


def _follows_an_end(text: str, at: int) -> bool:
    """Whether a line begins at ``at`` and the last code before it ends something."""
    if not at or text[at - 1] != "\n":
        return False
    for line in reversed(text[max(0, at - 4000) : at].splitlines()[1 if at > 4000 else 0 :]):
        if line.strip() and not line.lstrip().startswith("//"):
            last = line.rstrip()[-1]
            return "//" not in line and (last in _ENDS or last.isalnum() or last == "_")
    return False


FACTS = "project string, path string, pos int, newlines long, ends array<int>, depths array<array<int>>, places array<array<array<int>>>"
PLAN = "project string, path string, pos int, head int, cut int, line long"


def _facts(blocks: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                states = [block_facts(row["text"], s) for s in (CODE, COMMENT, RAW)] if row["path"].endswith(".go") else []
                out.append({
                    "project": row["project"], "path": row["path"], "pos": row["pos"], "newlines": row["text"].count("\n"),
                    "ends": [s[0] for s in states], "depths": [list(s[1]) for s in states],
                    "places": [[[*d, p] for d, p in s[2].items()] for s in states],
                })
            yield pa.RecordBatch.from_pylist(out, _schema(FACTS))

    return blocks.mapInArrow(read, FACTS)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else kinds[name]

    return pa.schema([(c.split()[0], kind(c.split()[1])) for c in ddl.split(", ")])


def _plan(facts: DataFrame) -> DataFrame:
    """For each block the segment its head belongs to, the place where it begins one itself (or null), and the lines before it.

    A file's facts are small: a row for each block.
    """
    columns = [c.split()[0] for c in FACTS.split(", ")[2:]]
    by_file = facts.groupBy("project", "path").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("blocks"))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state, depth, line, segment = CODE, (0, 0, 0), 0, 0
                for block in row["blocks"]:
                    cut = 0 if not block["ends"] and block["pos"] else None
                    if block["ends"]:
                        places = {tuple(p[:3]): p[3] for p in block["places"][state]}
                        cut = places.get(tuple(-d for d in depth))
                        depth = tuple(a + b for a, b in zip(depth, block["depths"][state], strict=True))
                        state = block["ends"][state]
                    out.append({"project": row["project"], "path": row["path"], "pos": block["pos"], "head": segment, "cut": cut, "line": line})
                    line += block["newlines"]
                    segment = segment if cut is None else block["pos"]
            yield pa.RecordBatch.from_pylist(out, _schema(PLAN))

    return by_file.mapInArrow(composed, PLAN)


def file_segments(files: DataFrame, giant_bytes: int = GIANT_BYTES, folder: str | None = None) -> DataFrame:
    """``(project, path, segment, first_line, content)`` of ``files``, ``first_line`` being the lines before a segment."""
    staged: Staging = staging(files.sparkSession, folder)
    block_chars = max(1, giant_bytes // BLOCKS)
    # a block ends with a line, and not with one whose end is escaped
    cut = F.regexp_extract_all("content", F.lit(rf"(?s:.{{1,{block_chars}}})[^\n]*+(?:(?<=\\)\n[^\n]*+)*+\n?"), 0)
    blocks = files.select("project", "path", F.posexplode(cut).alias("pos", "text")).repartition("project", "path", "pos")
    blocks = staged.stage(blocks)
    plan = staged.stage(_plan(_facts(blocks)))
    place = F.coalesce(F.col("cut"), F.length("text"))
    tail = F.expr("substring(text, cut + 1)")
    newlines = count_newlines(F.substring(F.col("text"), F.lit(1), F.col("cut")))
    parts = F.array(
        F.struct(F.col("head").alias("segment"), (F.col("pos") * 2).alias("part"), F.col("line").alias("line"), F.substring(F.col("text"), F.lit(1), place).alias("text")),
        F.when(F.col("cut").isNotNull(), F.struct(
            F.col("pos").alias("segment"), (F.col("pos") * 2 + 1).alias("part"), (F.col("line") + newlines).alias("line"), tail.alias("text")
        )),
    )
    dealt = blocks.join(plan, ["project", "path", "pos"]).select("project", "path", F.explode(F.filter(parts, lambda p: p.isNotNull() & (p["text"] != ""))).alias("p"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p.part", "p.text"))), lambda p: p["text"]), "")
    return dealt.groupBy("project", "path", F.col("p.segment").alias("segment")).agg(F.min("p.line").alias("first_line"), joined.alias("content"))


def is_giant(content: Column, giant_bytes: int) -> Column:
    return F.coalesce(F.octet_length(content) >= giant_bytes, F.lit(False))


def shifted(hits: Column, lines: Column) -> Column:
    """Hits of a segment with the lines of its file."""
    regex = F.lit(catalog.SOURCE_STAGE["regex"])
    return F.transform(hits, lambda h: F.struct(
        h["stage"].alias("stage"),
        F.when(h["stage"] == regex, h["a"] + lines).otherwise(h["a"]).alias("a"),
        F.when(h["stage"] == regex, h["b"]).otherwise(h["b"] + lines * (1 << 31)).alias("b"),
        (h["line"] + lines).alias("line"), h["rule_id"].alias("rule_id"), h["snippet"].alias("snippet"),
    ))

