"""Brace-depth scan over code text, as a native fold.

The rule: a double quote toggles a quote flag (escapes are not special);
``{`` and ``}`` outside quotes move a depth counter; the function is complete
at the first character where the depth is back to 0 after at least one
counted ``{``.  Single quotes are not special.

Instead of a per-character loop the text is split right after every
structural character (``"{}``); each piece is a run of ordinary characters
ending in one structural character (the last piece may have none), and
``aggregate`` folds over the pieces.  The state holds the end position of
every piece, so the cut point is exact.  The split is a one-character
look-behind, so the text is scanned once; the fold is linear in the number
of structural characters, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Split point: right after a double quote or a brace.
STRUCTURAL_SPLIT = '(?<=["{}])'


def brace_scan(text: Column) -> Column:
    """Final scan state: ``struct(depth, in_quote, seen, pos, stop)``.

    ``stop`` is the 1-based position of the character that closes the first
    function body, or -1 when the body never closes.
    """
    init = [F.lit(0).alias("depth"), F.lit(False).alias("in_quote"), F.lit(False).alias("seen"),
            F.lit(0).alias("pos"), F.lit(-1).alias("stop")]

    def step(acc: Column, piece: Column) -> Column:
        ch = F.substring(piece, -1, 1)
        outside = ~acc["in_quote"]
        opens = outside & (ch == "{")
        depth = acc["depth"] + F.when(opens, 1).when(outside & (ch == "}"), -1).otherwise(0)
        seen = acc["seen"] | opens
        pos = acc["pos"] + F.length(piece)
        fields = [depth.alias("depth"),
                  F.when(ch == '"', ~acc["in_quote"]).otherwise(acc["in_quote"]).alias("in_quote"),
                  seen.alias("seen"), pos.alias("pos")]
        fields.append(F.when((acc["stop"] < 0) & seen & (depth == 0), pos).otherwise(acc["stop"]).alias("stop"))
        return F.struct(*fields)

    return F.aggregate(F.split(text, STRUCTURAL_SPLIT, -1), F.struct(*init), step)


def stop_at_function(text: Column) -> Column:
    """Prefix of ``text`` that ends where the first function body closes.

    A body that never closes leaves the text unchanged.
    """
    stop = brace_scan(text)["stop"]
    return F.when(stop > 0, F.substring(text, F.lit(1), stop)).otherwise(text)


# The lexer of the structural screen: what a sign means depends on where it stands.
CODE, SLASH, STRING, STRING_ESCAPE, CHAR, CHAR_ESCAPE, LINE, BLOCK, STAR = range(9)
SIGNS = "/*\\\"'{}\n"        # classes 1 to 8 of signs; 0 is a run of any others
_PIECES = "[/*\\\\\"'{}\\n]|[^/*\\\\\"'{}\\n]+"


def lexer_table() -> list[list[int]]:
    """Next state by state and class of sign."""
    table = [[state] * (len(SIGNS) + 1) for state in range(9)]

    def on(state: int, signs: str, to: int) -> None:
        for c in signs:
            table[state][SIGNS.index(c) + 1] = to

    for state in (CODE, SLASH):
        table[state] = [CODE] * (len(SIGNS) + 1)
        on(state, '"', STRING)
        on(state, "'", CHAR)
    on(CODE, "/", SLASH)                                 # maybe a comment
    on(SLASH, "/", LINE)
    on(SLASH, "*", BLOCK)
    for state, escape, end in ((STRING, STRING_ESCAPE, '"'), (CHAR, CHAR_ESCAPE, "'")):
        on(state, "\\", escape)
        on(state, end, CODE)
        table[escape] = [state] * (len(SIGNS) + 1)       # whatever is escaped
    on(LINE, "\n", CODE)
    on(BLOCK, "*", STAR)
    table[STAR] = [BLOCK] * (len(SIGNS) + 1)
    on(STAR, "*", STAR)
    on(STAR, "/", CODE)
    return table


def syntax_screen(text: Column) -> Column:
    """Structural screen: braces of code balanced and never negative; strings, char literals and block comments closed.

    A state table is folded over the text's structural signs and the runs
    between them, so braces and quotes in comments, strings, char literals and
    escapes do not count.  A null text has no result.  Linear in the text.
    """
    flat = F.array(*[F.lit(to) for row in lexer_table() for to in row])
    opens, closes = SIGNS.index("{") + 1, SIGNS.index("}") + 1
    start = F.struct(F.lit(CODE).alias("state"), F.lit(0).alias("depth"), F.lit(False).alias("went_negative"))

    def step(acc: Column, piece: Column) -> Column:
        sign = F.when(F.length(piece) == 1, F.instr(F.lit(SIGNS), piece)).otherwise(F.lit(0))
        in_code = acc["state"].isin(CODE, SLASH)
        depth = acc["depth"] + F.when(in_code & (sign == opens), 1).when(in_code & (sign == closes), -1).otherwise(0)
        return F.struct(F.element_at(flat, acc["state"] * (len(SIGNS) + 1) + sign + 1).alias("state"), depth.alias("depth"),
                        (acc["went_negative"] | (depth < 0)).alias("went_negative"))

    end = F.aggregate(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), start, step)
    return (end["depth"] == 0) & ~end["went_negative"] & end["state"].isin(CODE, SLASH, LINE)
