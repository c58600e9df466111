"""Python's regular expressions in the dialect of Spark's ``rlike`` (Java)."""

from __future__ import annotations

import re

_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_GROUP = re.compile(r"\(\?P<(\w+)>")
_BACK = re.compile(r"\(\?P=(\w+)\)")
_FLAGS = re.compile(r"\(\?([aiLmsux]*)(?:-([imsx]+))?([:)])")
_ESCAPED = {"Z": r"\z"}  # the very end of the text


def _group_name(name: str, seen: dict[str, str]) -> str:
    """Java's group names have no underscores."""
    if name not in seen:
        seen[name] = f"g{len(seen)}x" + re.sub(r"[^A-Za-z0-9]", "", name)
    return seen[name]


def _char_class(pattern: str, at: int) -> tuple[str, int]:
    """The character class that begins at ``at``. Java nests classes and intersects them; Python does not."""
    end = at + 1
    out = ["["]
    if pattern[end:end + 1] == "^":
        out.append("^")
        end += 1
    first = True
    while end < len(pattern) and (pattern[end] != "]" or first):
        c = pattern[end]
        if c == "\\":
            out.append(pattern[end:end + 2])
            end += 2
        else:
            out.append("\\" + c if c in "[]&^" else c)
            end += 1
        first = False
    if end >= len(pattern):
        raise ValueError("unterminated character class")
    return "".join(out) + "]", end + 1


def to_java(pattern: str) -> str:
    """``pattern`` of Python's ``re`` so that Java finds the same in a text.

    Named groups and references, ``\\Z``, ``{,n}``, literal braces, brackets in
    classes and inline flags are rewritten; classes such as ``\\w`` stand for
    Unicode letters and ``.`` and ``$`` heed ``\\n`` only, as in Python.
    Syntax that Java has no counterpart of is a ``ValueError`` that names it.
    """
    re.compile(pattern)  # what Python refuses, this refuses
    out, at, names = [], 0, {}
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            two = pattern[at + 1:at + 2]
            octal = re.match(r"\\(0[0-7]{0,2}|[0-3][0-7]{2})", pattern[at:])
            if octal:
                out.append(f"\\x{int(octal.group(1), 8):02x}")
                at += len(octal.group())
            else:
                out.append(_ESCAPED.get(two, "\\" + two))
                at += 2
        elif c == "[":
            text, at = _char_class(pattern, at)
            out.append(text)
        elif m := _GROUP.match(pattern, at):
            out.append(f"(?<{_group_name(m.group(1), names)}>")
            at = m.end()
        elif m := _BACK.match(pattern, at):
            out.append(rf"\k<{_group_name(m.group(1), names)}>")
            at = m.end()
        elif pattern.startswith("(?#", at):
            at = pattern.index(")", at) + 1
        elif pattern.startswith("(?(", at):
            raise ValueError("conditional groups, (?(group)yes|no), have no counterpart in Java")
        elif (m := _FLAGS.match(pattern, at)) and (m.group(1) or m.group(2)):
            on, off, close = m.groups()
            if "L" in on:
                raise ValueError("the flag L has no counterpart in Java")
            if "x" in on + (off or ""):
                raise ValueError("verbose patterns (flag x) are not rewritten: leave blanks and comments out")
            java = "".join(f for f in on if f in "ims")
            # the flag a: ASCII classes only
            off = (off or "") + ("U" if "a" in on else "")
            out.append(f"(?{java}{'-' + off if off else ''}{close}" if java or off else ("(?:" if close == ":" else ""))
            at = m.end()
        elif c == "{":
            m = _QUANTIFIER.match(pattern, at)
            if m and (m.group(1) or m.group(3)):
                out.append(f"{{{m.group(1) or 0}{m.group(2)}{m.group(3)}}}")
                at = m.end()
            else:
                out.append(r"\{")
                at += 1
        else:
            out.append(c)
            at += 1
    return "(?Ud)" + "".join(out)
