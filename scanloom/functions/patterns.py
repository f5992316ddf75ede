"""RE2 line patterns as Java patterns."""

from __future__ import annotations

import re

from scanloom.functions.catalog import LINE_RULES

# RE2 ignore-case folds exactly two non-ASCII characters into ASCII letters. Java's (?u) folds more
# (U+0130 and U+0131 to i), so ignore-case stays ASCII and the two extra characters are written out.
_FOLDS = {"s": "\u017f", "k": "\u212a"}

# White space of RE2's \s without the newline: a line never holds one, and leaving it out keeps a match
# inside one line when the pattern is tried on a whole file.
_BLANK = r"\t\f\r "


# Written by hand, by rule id, because the mechanical form backtracks over every pair of positions of a long line: the
# first keyword of a line and the first plus behind it are as good as any later ones.
_BY_HAND = {
    "REGEX007": r"""(?idm)^(?>.*?(?:[sſ]elect|in[sſ]ert|update|delete))[^\n+]*+\+.*['"][\t\f\r ]*+\+""",
}
_SAME_AS = {rule[0]: rule[3] for rule in LINE_RULES}

# Named classes of RE2, all ASCII.
_NAMED = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\x0B\f\r ", "upper": "A-Z",
    "word": "0-9A-Za-z_",
}
_PIECE = re.compile(
    r"\\[pP]\{[^}]*\}|\\x\{[0-9A-Fa-f]+\}|\\x[0-9A-Fa-f]{2}|\\[pP].|\\Q.*?(?:\\E|\Z)|\\.|\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]"
    r"|\(\?P?<\w+>|\(\?[imsU]*(?:-[imsU]+)?[:)]|.",
    re.S,
)


def pattern_pieces(re2: str) -> list[str]:
    """An RE2 pattern cut into classes, escapes, group openings and single characters."""
    return _PIECE.findall(re2)


def _property(piece: str) -> str:
    """A character property: scripts have another name here than general categories."""
    found = re.fullmatch(r"\\([pP])\{(\^?)(\w+)\}", piece)
    if not found:
        return piece
    letter = found[1] if not found[2] else "pP".replace(found[1], "")
    return f"\\{letter}{{{'Is' if len(found[3]) > 2 else ''}{found[3]}}}"


def _negated_named(name: str) -> str:
    return f"[^{_NAMED[name]}\\n]"


def java_line_pattern(re2: str, rule_id: str = "") -> str:
    """The Java pattern that accepts the same lines as an RE2 pattern, and never matches across a newline.

    Ignore-case stays ASCII with the two characters RE2 folds besides, unless the pattern holds other letters: then it
    folds as RE2 does, by Unicode. Groups of flags may stand anywhere.
    """
    if rule_id in _BY_HAND and _SAME_AS.get(rule_id) == re2:
        return _BY_HAND[rule_id]
    wide = bool(re.search(r"[^\x00-\x7F]|\\[pP]|\\x\{", re2))
    flags = re.match(r"\(\?([ims]+)\)", re2)
    start = flags.group(1) if flags else ""
    body = re2[flags.end():] if flags else re2
    ignore_case = ["i" in start]  # by open group

    def fold(char: str) -> str:
        if not ignore_case[-1]:
            return char
        if wide:  # Unicode folding of Java takes dotless and dotted I for an i, RE2 doesn't
            return f"(?-u:{char})" if char in "iI" else char
        extra = _FOLDS.get(char.lower())
        return f"[{char}{extra}]" if extra else char

    def char_class(text: str) -> str:
        inside = text[1:-1]
        negated, inside = inside.startswith("^"), inside.removeprefix("^")
        pieces = re.findall(r"\[:\^?\w+:\]|\\[pP]\{[^}]*\}|\\x\{[0-9A-Fa-f]+\}|\\.|.", inside, re.S)
        plain = "".join(p for p in pieces if not p.startswith("\\") and not p.startswith("[:"))
        covers_s = re.search(r"s|a-z|A-Z", plain, re.I) or any(p in ("[:alpha:]", "[:lower:]", "[:upper:]", "[:alnum:]", "[:word:]") for p in pieces)
        covers_k = re.search(r"k|a-z|A-Z", plain, re.I) or (covers_s and "[:" in inside)
        java = {r"\s": _BLANK, "[": r"\[", "&": r"\&"}
        out = ""
        for piece in pieces:
            if piece.startswith("[:"):
                name = piece[2:-2].removeprefix("^")
                if name not in _NAMED:
                    raise ValueError(f"unknown character class: {piece}")
                out += _negated_named(name) if piece[2] == "^" else _NAMED[name]
            else:
                out += java.get(piece, _property(piece))
        if ignore_case[-1] and not wide:
            out += ("\u017f" if covers_s else "") + ("\u212a" if covers_k else "")
        return f"[{'^' + chr(92) + 'n' if negated else ''}{out}]"

    def flag_group(piece: str) -> str:
        names = piece[2:-1]
        on, _, off = names.partition("-")
        if "U" in names:
            raise ValueError("the flag U is not supported")
        now = ("i" in on) or (ignore_case[-1] and "i" not in off)
        if piece.endswith(":"):
            ignore_case.append(now)
        else:
            ignore_case[-1] = now
        extra = "u" if wide and "i" in on else ""
        return f"(?{on}{extra}{'-' + off if off else ''}{piece[-1]}"

    out = []
    for piece in _PIECE.findall(body):
        if piece == r"\s":
            out.append(f"[{_BLANK}]")
        elif piece == r"\S":
            out.append(f"[^{_BLANK}\\n]")
        elif piece.startswith("["):
            out.append(char_class(piece))
        elif piece.startswith("(?") and "<" in piece:
            ignore_case.append(ignore_case[-1])
            out.append(piece.replace("?P<", "?<"))
        elif piece.startswith("(?"):
            out.append(flag_group(piece))
        elif piece == "(":
            ignore_case.append(ignore_case[-1])
            out.append(piece)
        elif piece == ")" and len(ignore_case) > 1:
            ignore_case.pop()
            out.append(piece)
        else:
            out.append(fold(piece) if len(piece) == 1 and piece.isalpha() else _property(piece))
    kept = "".join(f for f in start if f != "s" or "s" in re2) + ("u" if wide and "i" in start else "")
    return f"(?{kept}d)" + "".join(out)


def glob_regex(pattern: str) -> str | None:
    """Regex text for a path glob in which ``*`` and ``?`` stop at ``/``; ``None`` when it is malformed."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        if char == "*":
            out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
        elif char == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        elif char == "[":
            found = re.match(r"\[(\^?)((?:(?:\\.|[^\]\\-])(?:-(?:\\.|[^\]\\-]))?)+)\]", pattern[i:], re.S)
            if not found:
                return None
            ranges = []
            for lo, hi in re.findall(r"(\\.|[^\\-])(?:-(\\.|[^\\-]))?", found.group(2), re.S):
                lo, hi = lo[-1], (hi or lo)[-1]
                if lo <= hi:
                    ranges.append(f"{re.escape(lo)}-{re.escape(hi)}")
            if ranges:
                out.append(f"[{found.group(1)}{''.join(ranges)}]")
            else:
                out.append("(?s:.)" if found.group(1) else "(?!)")
            i += found.end() - 1
        else:
            out.append(re.escape(char))
        i += 1
    return "".join(out)
