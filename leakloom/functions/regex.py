"""Linear-time dialect patterns for the JVM's and Python's matchers.

Rules are written in the dialect whose word, space and line classes are ASCII and whose ``$`` is the
very end of the text; the backtracking matchers differ in these and are told so explicitly.
"""

from __future__ import annotations

_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NOT_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_SPACE = r"\t\n\f\r "


def _translated(pattern: str, end: str, java: bool) -> str:
    out, inside, at, multiline = [], False, 0, False
    while at < len(pattern):
        c = pattern[at]
        pair = pattern[at : at + 2]
        if c == "\\" and len(pair) == 2:
            if pair == r"\s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif pair == r"\S" and not inside:
                out.append(f"[^{_SPACE}]")
            elif pair == r"\d":
                out.append("0-9" if inside else "[0-9]")
            elif pair == r"\w":
                out.append("0-9A-Za-z_" if inside else _WORD)
            elif pair == r"\W" and not inside:
                out.append("[^0-9A-Za-z_]")
            elif pair == r"\b" and not inside:
                out.append(_BOUNDARY)
            elif pair == r"\B" and not inside:
                out.append(_NOT_BOUNDARY)
            elif pair == r"\z":
                out.append(end)
            elif pair == r"\A":
                out.append(r"\A")
            else:
                out.append(pair)
            at += 2
            continue
        if inside:
            if c == "[" and pattern.startswith("[:", at):
                raise ValueError("named classes aren't supported")
            out.append("\\" + c if c in "[&" else c)
            inside = c != "]" or out[-2:] in (["[", "]"], ["[^", "]"])
        elif c == "[":
            out.append("[^" if pair == "[^" else "[")
            at += pair == "[^"
            inside = True
        elif c == "(" and pattern.startswith("(?", at) and pattern[at + 2 : at + 3] not in ":=!<P":
            close = min(k for k in (pattern.find(")", at), pattern.find(":", at)) if k >= 0)
            flags = pattern[at + 2 : close]
            multiline |= "m" in flags.split("-")[0]
            out.append("(?" + (flags.replace("i", "iu") if java and "i" in flags.split("-")[0] else flags) + pattern[close])
            at = close
        elif c == "(" and pattern.startswith("(?P<", at):
            out.append("(?<" if java else "(?P<")
            at += 3
        elif c == "$" and not multiline:
            out.append(end)
        else:
            out.append(c)
        at += 1
    return "".join(out)


def to_java(pattern: str) -> str:
    """For Spark's regular-expression functions; lines end at \\n only."""
    return "(?d)" + _translated(pattern, r"\z", True)


def to_python(pattern: str) -> str:
    """For Python's ``re``."""
    return _translated(pattern, r"\Z", False)
