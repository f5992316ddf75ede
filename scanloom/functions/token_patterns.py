r"""A small pattern language over the tokens of Go files, for rules of a user.

A pattern is a list of items with blanks between them, each for one token:

* a token as it stands in the file: ``rand``, ``.``, ``(``, ``:=``, ``""``
* ``<name>``, ``<number>``, ``<string>``, ``<rune>``: any token of that kind; ``<any>``: any token at all
* ``<name:REGEX>``: a name that all of REGEX matches; letters, digits, ``_ | ( ) ? * + . [ ] ^ -`` and a leading ``(?i)``
* any of them in angle brackets with ``?`` or ``{m,n}`` behind: so many of them, 50 at most
* ``!`` and an item, first or last in the pattern: the token before, or after, is not that

White space, line ends and comments between tokens don't count. A match is reported on the line of its first token.
``exec . <name:Command(Context)?> ( !<string>`` finds commands that don't begin with a literal.
"""

from __future__ import annotations

import re

#: Most tokens that a repeated item stands for, and blanks and line ends that a look back passes.
MOST, BACK = 50, 200

_GAP = r"[ \n]+"
_KINDS = {
    "name": r"[\p{L}_][\p{L}\p{Nd}_]*", "number": r"[0-9][\p{L}\p{Nd}_.]*", "string": r"""(?:"s"|""|`s`)""", "rune": "'r'", "any": r"[^ \n]+",
}
_ITEM = re.compile(r"<(\w+)(?::([^<>\s]+))?>(\?|\{\d+,\d+\})?")


def _one(item: str) -> tuple[str, str]:
    """Pattern of an item, and how often it may stand ('' for once)."""
    found = _ITEM.fullmatch(item)
    if not found:
        if re.fullmatch(r"<\w+.*", item):
            raise ValueError(f"unknown item: {item}")
        if re.match(r"//|/\*|[\"'`].", item) and item != '""':
            raise ValueError(f"only the empty string can be named, others are <string>, <rune>: {item}")
        return re.escape(item), ""
    kind, regex, times = found[1], found[2], found[3] or ""
    if kind not in _KINDS or (regex and kind != "name"):
        raise ValueError(f"unknown item: {item}")
    if times.startswith("{") and not int(times[1:-1].split(",")[0]) <= int(times[1:-1].split(",")[1]) <= MOST:
        raise ValueError(f"at most {MOST} tokens may be repeated: {item}")
    if not regex:
        return _KINDS[kind], times
    if not re.fullmatch(r"(?:\(\?i\))?[\w|()?*+.\[\]^-]+", regex) or "(?" in regex.removeprefix("(?i)"):
        raise ValueError(f"this name pattern is not supported: {item}")
    if re.search(r"\[[^\]]*\.[^\]]*\]", regex):
        raise ValueError(f"a dot in brackets is not supported: {item}")
    re.compile(regex)
    flags = "(?i:" if regex.startswith("(?i)") else "(?:"
    return rf"(?=[\p{{L}}_]){flags}{regex.removeprefix('(?i)').replace('.', r'[^ \n]')})(?=[ \n])", times


def token_regex(pattern: str) -> str:
    """The regex that matches, with no width, before the first token of each match in a text of tokens with blanks between."""
    items = pattern.split()
    before = after = ""
    if items and items[0].startswith("!") and items[0] not in ("!", "!="):
        out, times = _one(items.pop(0)[1:])
        if times or re.search(r"(?<!\\)[*+]", out):
            raise ValueError("only a token, <string> or <rune> can be ruled out before a match")
        before = rf"(?<! {out}[ \n]{{0,{BACK}}})"
    if items and items[-1].startswith("!") and items[-1] not in ("!", "!="):
        after = rf"(?!{_GAP}{_one(items.pop()[1:])[0]}(?=[ \n]))"
    if not items:
        raise ValueError("no pattern")
    if re.match(r"<.*>(\?|\{0,)", items[0]):
        raise ValueError("the first token of a match has to be there")
    body = "".join(f"(?:{_GAP}{one}(?=[ \\n])){times}" for one, times in map(_one, items))
    # a run of blanks and line ends stands before each token, and the match begins at its last blank
    # the look back tries every length of a run, so it comes last, only where the rest matches
    return f"(?={body.replace(f'(?:{_GAP}', '(?: ', 1)}{after}){before}"


def needed_token(pattern: str) -> str:
    """The longest token that a match holds as it stands, '' if there is none."""
    return max((i for i in pattern.split() if not i.startswith(("!", "<")) or i in ("!", "!=", "<", "<=", "<-", "<<", "<<=")), key=len, default="")
