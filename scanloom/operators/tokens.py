r"""Token rules for Go files: a lexical token table and three structural rules over it.

Comments and literals are single tokens, so nothing inside them can look like code. A file is tokenised inside
its own row with built-in functions. The rules run on the *code text* of a file: its tokens joined by single
blanks, comments dropped, literals replaced by short stand-ins, and every newline of the file kept, so that the
number of newlines before a token gives its line. Each rule puts a marker character into that text, and the
marked lines are the hits. Nothing is shuffled and no window is needed.

Known deviations from a full parse: files that do not parse still give findings, and a blank identifier behind
an index or call that spans lines is reported on the line of its last part.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import catalog
from scanloom.functions.text import count_newlines
from scanloom.functions.token_patterns import needed_token, token_regex
from scanloom.operators.lines import HITS
from scanloom.operators.segments import file_segments, is_giant

_NAME = r"[\p{L}_][\p{L}\p{Nd}_]*"
# Possessive repeats keep long literals off the call stack. Blanks match nothing and so are skipped.
LEXER = (
    r"//[^\n]*"
    r"|/\*(?s:.*?)\*/"
    r'|"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"'
    r"|`[^`]*`"
    r"|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
    rf"|{_NAME}"
    r"|[0-9][\p{L}\p{Nd}_.]*"
    r"|\n|\.\.\.|<<=|>>=|&\^=|&\^|:=|==|!=|<=|>=|<-|<<|>>|&&|\|\||\+\+|--|[-+*/%&|^]="
    r"|[^ \t\r\n]"
)

_GAP = r"[ \n]+"
_WEAK_RANDOM, _EMPTY_PASSWORD, _IGNORED_ERROR = "\u0001", "\u0002", "\u0003"
_USER = "\u0004"
_MARKS = _WEAK_RANDOM + _EMPTY_PASSWORD + _IGNORED_ERROR + _USER


def _is_comment(token: Column) -> Column:
    return F.startswith(token, F.lit("//")) | (F.startswith(token, F.lit("/*")) & (F.length(token) > 2))


def raw_tokens(content: Column) -> Column:
    """Tokens, newlines and comments of the text as an array."""
    return F.regexp_extract_all(content, F.lit(LEXER), 0)


def go_tokens(files: DataFrame, giant_bytes: int | None = None, folder: str | None = None) -> DataFrame:
    """``(project, path, tok_idx, tok, line)`` of Go files, without white space and comments.

    A token that spans lines is cut into its first line and the newlines after it, so lines can be numbered by
    position; the newlines inside the token are carried as a private character and put back at the end. Files of
    ``giant_bytes`` or more are cut into segments that are dealt to many tasks and staged in ``folder``.
    """
    columns = ["project", "path", "tok_idx", "tok", "line"]
    go = _go_files(files)
    if giant_bytes is None:
        return _tokens(go, "project", "path").select(*columns)
    giant = is_giant(F.col("content"), giant_bytes)
    keys = ["project", "path", "segment"]
    parts = _tokens(file_segments(go.where(giant), giant_bytes, folder), *keys, "first_line")
    before = Window.partitionBy("project", "path").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*keys).agg(F.count("*").alias("n"))
    starts = sizes.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    moved = parts.join(starts, keys).withColumn("tok_idx", F.col("tok_idx") + F.col("start")).withColumn("line", F.col("line") + F.col("first_line"))
    return _tokens(go.where(~giant), "project", "path").select(*columns).unionByName(moved.select(*columns))


def _tokens(files: DataFrame, *keys: str) -> DataFrame:
    held, end = "\ufdd0", "\ufdd1"
    flat = F.transform(
        raw_tokens(F.col("content")),
        lambda t: F.when(t == "\n", t)
        .when(_is_comment(t), F.repeat(F.lit("\n"), count_newlines(t)))
        .when(
            F.contains(t, F.lit("\n")),
            F.concat(F.translate(t, "\n", held), F.lit(end), F.repeat(F.lit("\n"), count_newlines(t))),
        )
        .otherwise(F.concat(t, F.lit(end))),
    )
    by_line = F.transform(
        F.split(F.array_join(flat, ""), "\n", -1),
        lambda text, index: F.transform(
            F.array_remove(F.split(text, end, -1), ""),
            lambda t: F.struct(F.translate(t, held, "\n").alias("tok"), (index + 1).cast("bigint").alias("line")),
        ),
    )
    exploded = files.select(*keys, F.posexplode(F.flatten(by_line)).alias("tok_idx", "t"))
    return exploded.select(*keys, F.col("tok_idx").cast("bigint").alias("tok_idx"), "t.tok", "t.line")


def _go_files(files: DataFrame) -> DataFrame:
    return files.where(is_go(F.col("path")))


def is_go(path: Column) -> Column:
    """Only the exact suffix counts; ``A.GO`` is scanned by the line rules alone."""
    return F.endswith(path, F.lit(".go"))


def _code_text(content: Column) -> Column:
    """Tokens joined by single blanks, one blank at either end, newlines kept as tokens of their own."""

    def shown(t: Column) -> Column:
        longer = F.length(t) > 1
        newlines = F.repeat(F.lit("\n"), count_newlines(t))
        needs_care = F.ascii(t).isin([ord(c) for c in "/`\"'" + _MARKS])
        return (
            F.when(~needs_care | (t == '""'), t)
            .when(_is_comment(t), newlines)
            .when(longer & F.startswith(t, F.lit("`")), F.concat(F.lit("`s`"), newlines))
            .when(longer & F.startswith(t, F.lit('"')), F.concat(F.lit('"s"'), newlines))
            .when(longer & F.startswith(t, F.lit("'")), F.concat(F.lit("'r'"), newlines))
            .when(F.startswith(t, F.lit("/")), t)
            .otherwise(F.lit("?"))
        )

    tokens = F.array_remove(F.transform(raw_tokens(content), shown), "")
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def _mark_weak_random(code: Column) -> Column:
    """A call ``rand.X(`` on the bare name, not on a selector such as ``a.rand``."""
    selectors_out = F.regexp_replace(code, rf" \.({_GAP})rand(?= )", " .$1?rand")
    call = rf" rand(?={_GAP}\.{_GAP}{_NAME}{_GAP}\( )"
    return F.regexp_replace(selectors_out, call, f" {_WEAK_RANDOM}rand")


def _mark_empty_password(code: Column) -> Column:
    """``name == ""`` where neither side is part of a larger operand."""
    test = (
        r"(?!\d)[\p{L}\p{Nd}_]*(?i:password|passwd)[\p{L}\p{Nd}_]*" + _GAP + "==" + _GAP + '""'
        rf"(?!{_GAP}(?:[-+*/%&|^]|<<|>>|&\^|\[) )"
    )
    before = r"(?:[-.+*/%&|^!<>]|==|!=|<=|>=|<-|<<|>>|&\^)"
    operands_out = F.regexp_replace(code, rf" ({before}{_GAP})(?={test})", " $1?")
    return F.regexp_replace(operands_out, rf" (?={test})", f" {_EMPTY_PASSWORD}")


def _mark_ignored_error(code: Column) -> Column:
    """An assignment whose last target is ``_``; the mark stands where the list of targets begins."""
    # Declarations are not assignments: take the "=" of `var a, _ = x` (also const and type) out first.
    name_list = r"[\p{L}\p{Nd}_, ]*+(?:(?<=, )\n[ \n]*+[\p{L}\p{Nd}_, ]*+)*+"
    declared = F.regexp_replace(code, rf"( (?:var|const|type) {name_list}(?<= _ ))(?== )", "$1?")
    # A list of targets begins behind a bracket, ";", ":" or a run of newlines that does not follow a comma. Each
    # run counts once, so a long list of lines is read from its first line only.
    begin = r"(?<=[;{}:(]|\A|(?<![,\n] |\n)\n)([ \n]*+)"
    part = r"[^;\n{}:=(]*+"
    targets = rf"({part}(?:(?<=, )\n[ \n]*+{part})*+)"
    operator = r"(?<= _ (?:[-+*/%&|^]|<<|>>|&\^)?)(?=:?= (?![ \n]*range ))"
    return F.regexp_replace(declared, begin + targets + operator, f"$1{_IGNORED_ERROR}$2")


# Events of a file that are taken together when group members are looked for.
_TOGETHER = 512


def _without_group_members(marked: Column) -> Column:
    """Takes the marks off the members of ``var ( ... )``, ``const ( ... )`` and ``type ( ... )`` groups.

    Brackets, group openings and marks are walked twice, in runs of ``_TOGETHER``: first for the bracket depths and open
    groups at the start of each run, then inside each run for its marks, so that no list grows with the file. A mark is a
    declaration when the innermost open group has the brace depth of the mark; inside a function literal in a group the
    depth is greater, and the assignment counts.
    """
    no_groups = F.array().cast("array<struct<paren:int,brace:int>>")

    def state(paren: Column, brace: Column, groups: Column) -> Column:
        return F.struct(paren.alias("paren"), brace.alias("brace"), groups.alias("groups"))

    def step(at: Column, event: Column) -> Column:
        paren, brace, groups = at["paren"], at["brace"], at["groups"]
        opens = F.startswith(event, F.lit(" "))
        size = F.size(groups)
        inner = F.get(groups, size - 1)
        new_paren = paren + F.when(opens | (event == "("), 1).when(event == ")", -1).otherwise(0)
        new_brace = brace + F.when(event == "{", 1).when(event == "}", -1).otherwise(0)
        closes = (event == ")") & (size > 0) & (inner["paren"] == new_paren) & (inner["brace"] == brace)
        here = F.array(F.struct(paren.alias("paren"), brace.alias("brace")))
        return state(
            new_paren, new_brace,
            F.when(opens, F.concat(groups, here)).when(closes, F.slice(groups, F.lit(1), size - 1)).otherwise(groups),
        )

    def judge(at: Column, event: Column) -> Column:
        now = at["now"]
        size = F.size(now["groups"])
        member = (size > 0) & (F.get(now["groups"], size - 1)["brace"] == now["brace"])
        is_mark = event == _IGNORED_ERROR
        return F.struct(
            F.when(is_mark, now).otherwise(step(now, event)).alias("now"),
            F.when(is_mark, F.concat(at["members"], F.array(member))).otherwise(at["members"]).alias("members"),
        )

    events = F.regexp_extract_all(marked, F.lit(rf" (?:var|const|type){_GAP}\( |[(){{}}{_IGNORED_ERROR}]"), 0)
    cut = F.transform(
        F.array(events),
        lambda all_: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _TOGETHER).cast("int")),
            lambda k: F.slice(all_, k * _TOGETHER + 1, F.lit(_TOGETHER)),
        ),
    )
    begin = state(F.lit(0), F.lit(0), no_groups)
    unstarted = F.array().cast("array<struct<paren:int,brace:int,groups:array<struct<paren:int,brace:int>>>>")
    starts = lambda runs: F.aggregate(
        runs,
        F.struct(begin.alias("now"), unstarted.alias("starts")),
        lambda at, run: F.struct(
            F.aggregate(run, at["now"], step).alias("now"), F.concat(at["starts"], F.array(at["now"])).alias("starts")
        ),
        lambda at: at["starts"],
    )
    of_run = lambda run, at: F.aggregate(
        run, F.struct(at.alias("now"), F.array().cast("array<boolean>").alias("members")), judge, lambda done: done["members"]
    )
    members = F.transform(cut, lambda runs: F.flatten(F.zip_with(runs, starts(runs), of_run)))
    # The piece after mark k is element k of the split, counted from 0.
    both = F.array(F.struct(F.split(marked, _IGNORED_ERROR, -1).alias("pieces"), F.get(members, F.lit(0)).alias("members")))
    joined = F.transform(
        both,
        lambda x: F.array_join(
            F.transform(
                x["pieces"],
                lambda piece, k: F.when(
                    (k == 0) | F.get(x["members"], k - 1), piece
                ).otherwise(F.concat(F.lit(_IGNORED_ERROR), piece)),
            ),
            "",
        ),
    )
    return F.get(joined, F.lit(0))


_RULES = [
    # rule, marker, marking function, cheap test on the raw content, whether the source line is quoted
    ("AST001", _WEAK_RANDOM, _mark_weak_random, r"(?<![\p{L}\p{Nd}_])rand\s*[./]", False),
    ("AST002", _EMPTY_PASSWORD, _mark_empty_password, r'(?i)passw(?:or)?d\w*\s*[=/]', False),
    ("AST003", _IGNORED_ERROR, _mark_ignored_error, r"(?<![\p{L}\p{Nd}_])_\s*(?:/|[-+*%&|^<>:]*=)", True),
]


def with_token_hits(files: DataFrame, rule_ids: list[str] | None = None, token_rules: list[tuple] | None = None) -> DataFrame:
    """Adds ``token_hits``: matches of the token rules, by rule and then by position.

    One hit per matching node, so two calls on one line count twice in the risk of the file and become one row
    when findings are merged. ``token_rules`` come after the built-in ones and have the columns of the catalog, with a
    pattern of ``functions.token_patterns``.
    """
    rules = [(n, *r) for n, r in enumerate(_RULES, start=1) if rule_ids is None or r[0] in rule_ids]
    own = [
        (n, r[0], token_regex(r[3]), needed_token(r[3]))
        for n, r in enumerate(token_rules or [], start=len(_RULES) + 1) if rule_ids is None or r[0] in rule_ids
    ]
    content, text = F.col("content"), F.col("_text")
    go = is_go(F.col("path"))
    out, arrays = files, []
    hinted = content.rlike("|".join(f"(?:{r[4]})" for r in rules)) if rules else F.lit(False)
    if own:
        asked = [F.contains(content, F.lit(needed)) if needed else F.lit(True) for _, _, _, needed in own]
        out = out.withColumn("_text", F.when(go & reduce(or_, [hinted, *asked]), _code_text(content)))
        arrays += [_user_hits(*rule, text, content) for rule in own]
    if rules:
        out = out.withColumn("_code", F.when(go & hinted, text if own else _code_text(content)))
        for _, _, _, mark, _, _ in rules:
            out = out.withColumn("_code", mark(F.col("_code")))
        code = F.col("_code")
        if any(r[2] == _IGNORED_ERROR for r in rules):
            grouped = code.rlike(rf" (?:var|const|type){_GAP}\( ") & F.contains(code, F.lit(_IGNORED_ERROR))
            out = out.withColumn("_code", F.when(grouped, _without_group_members(code)).otherwise(code))
        out = out.withColumn("_lines", F.when(F.col("_code").rlike(f"[{_MARKS}]"), _marked_lines(F.col("_code"), content)))
        kinds = F.array(
            *[
                F.struct(
                    F.lit(number).cast("bigint").alias("number"), F.lit(rule_id).alias("rule_id"),
                    F.lit(marker).alias("marker"), F.lit(quoted).alias("quoted"),
                )
                for number, rule_id, marker, _, _, quoted in rules
            ]
        )
        by_rule = F.transform(
            kinds,
            lambda rule: F.flatten(
                F.transform(
                    F.filter(F.col("_lines"), lambda line: F.contains(line["code"], rule["marker"])), lambda line: _line_hits(rule, line)
                )
            ),
        )
        arrays.insert(0, F.flatten(by_rule))
    empty = F.array().cast(HITS)
    hits = F.concat(*[F.coalesce(a, empty) for a in arrays]) if arrays else empty
    return out.withColumn("token_hits", hits).drop("_code", "_lines", "_text")


def _marked_lines(code: Column, content: Column) -> Column:
    """Lines of a marked code text that hold a mark, with the source line and its number."""
    lines = F.arrays_zip(F.split(code, "\n", -1).alias("code"), F.split(content, "\n", -1).alias("text"))
    numbered = F.transform(
        lines, lambda l, i: F.struct(l["code"].alias("code"), l["text"].alias("text"), (i + 1).alias("line"))
    )
    return F.filter(numbered, lambda l: l["code"].rlike(f"[{_MARKS}]"))


def _line_hits(rule: Column, line: Column) -> Column:
    """One hit per mark of the rule on the line."""
    marks = F.length(line["code"]) - F.length(F.replace(line["code"], rule["marker"], F.lit("")))
    line_no = line["line"].cast("bigint")
    return F.transform(
        F.sequence(F.lit(1), marks),
        lambda k: F.struct(
            F.lit(catalog.SOURCE_STAGE["ast"]).alias("stage"),
            rule["number"].alias("a"),
            (line_no * (1 << 31) + k).alias("b"),
            line_no.alias("line"),
            rule["rule_id"].alias("rule_id"),
            F.when(rule["quoted"], line["text"]).otherwise(F.lit("")).alias("snippet"),
        ),
    )


def _user_hits(number: int, rule_id: str, regex: str, needed: str, text: Column, content: Column) -> Column:
    """Hits of one rule of a user, marked in a code text of its own; null without any."""
    found = text.rlike(regex)
    if needed:
        found = F.contains(content, F.lit(needed)) & found
    rule = F.struct(
        F.lit(number).cast("bigint").alias("number"), F.lit(rule_id).alias("rule_id"), F.lit(_USER).alias("marker"), F.lit(True).alias("quoted")
    )
    marked = F.when(found, _marked_lines(F.regexp_replace(text, regex, _USER), content))
    return F.flatten(F.transform(marked, lambda line: _line_hits(rule, line)))
