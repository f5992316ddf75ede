"""Texts that every match of a line pattern holds, for cheap tests before the pattern itself."""

from __future__ import annotations

import re

from scanloom.functions.patterns import pattern_pieces

#: Bytes that a text of the index has at least.
LEAST = 3
#: White space inside a line that stands as a blank in the texts, and has to in what is searched for them.
BLANKS = "\t\v\f\r"


def required_texts(pattern: str, least: int = LEAST) -> frozenset[str] | None:
    """Texts, in lower case, one of which each match of an RE2 pattern holds whatever its flags; None if none is known.

    White space is a blank in them.
    Only plain characters of ASCII and accented Latin letters in a row count, ``least`` bytes of them or more. Of several
    such sets the one whose shortest text is longest is taken.
    """
    pieces = pattern_pieces(pattern)
    at = 0

    def size_of(texts: frozenset[str]) -> int:
        return min(len(text.encode()) for text in texts)

    def least_repeats() -> int | None:
        """Consumes a quantifier; None without one."""
        nonlocal at
        found = re.match(r"(?:([*?])|(\+)|\{(\d+)(?:,\d*)?\})[?+]?", "".join(pieces[at : at + 24]))
        if not found:
            return None
        size = 0
        while size < len(found[0]):
            size += len(pieces[at])
            at += 1
        return 0 if found[1] else 1 if found[2] else int(found[3])

    def alternatives() -> frozenset[str] | None:
        """Consumes up to the end of a group or of the pattern."""
        nonlocal at
        branches, best, run = [], None, ""

        def better(texts: frozenset[str] | None) -> None:
            nonlocal best
            if texts and size_of(texts) >= least and (best is None or size_of(texts) > size_of(best)):
                best = texts

        while at < len(pieces) and pieces[at] != ")":
            piece = pieces[at]
            at += 1
            plain = piece if len(piece) == 1 and piece not in ".^$|()[]{}*+?\\" else None
            if len(piece) == 2 and piece[0] == "\\" and not piece[1].isalnum():
                plain = piece[1]
            if piece in (r"\s", "[[:space:]]", *BLANKS):
                plain = " "
            if plain is not None and (ord(plain) < 128 or "\u00c0" <= plain <= "\u00ff"):
                repeats = least_repeats()
                if repeats == 0:
                    better(frozenset([run]))
                    run = ""
                else:
                    run += plain.lower()
                    if repeats is not None:  # what follows may follow another repetition
                        better(frozenset([run]))
                        run = plain.lower() if repeats == 1 else ""
                continue
            better(frozenset([run]))
            run = ""
            if piece == "|":
                branches.append(best)
                best = None
            elif piece.startswith("(") and not re.fullmatch(r"\(\?[a-zA-Z-]*\)", piece):
                inside = alternatives()
                at += 1
                if least_repeats() != 0:
                    better(inside)
            else:
                least_repeats()
        better(frozenset([run]))
        branches.append(best)
        return None if None in branches else frozenset().union(*branches)

    texts = alternatives()
    return texts if at >= len(pieces) else None
