"""Regular expressions of the RE2 syntax, said in Java's, which Spark runs.

What both have means the same after it: `.` stands for all but the line feed, `$` for the end of the text alone, `\\s`, `\\d`, `\\w`
and `\\b` for ASCII, `\\v` for one character, braces that are no count for themselves. Groups keep their numbers, and lose their
names. What RE2 has not, such as references to groups, looking around, and possessive or stacked repetitions, is refused,
as are repetitions of what is nothing but a repetition: RE2 takes time in proportion to a text for them, Java's may double it
with every character.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WORD = "0-9A-Za-z_"
EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
NO_EDGE = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
#: Classes by name, as their members in a class of Java's.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": WORD, "xdigit": "0-9A-Fa-f",
}
PERL = {"d": "0-9", "s": r"\t\n\f\r ", "w": WORD}
CONTROLS = {"a": 7, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
MOST = 1000  # repetitions that a count may ask for
COUNT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")


@dataclass
class _Part:
    """What the alternatives of a group hold so far. solid: items of this one that a text must have and that don't repeat without bound; loops: whether any does."""

    flags: str
    solid: int = 0
    loops: bool = False
    alone: bool = False  # an alternative before is nothing but a repetition
    some: bool = True  # each alternative before has something solid
    last: tuple[bool, bool] | None = None  # of the item before: (it is solid, to repeat it may double the work)
    out: list[str] = field(default_factory=list)


def _char(code: int) -> str:
    """A character that stands for itself, in and out of classes."""
    c = chr(code)
    return c if c.isascii() and c.isalnum() or code > 127 and not 0xD800 <= code < 0xE000 else rf"\x{{{code:X}}}"


def translate(pattern: str, allow: str = "") -> str:
    """Java's form of a pattern; ValueError for what isn't RE2's, but for escapes of letters in `allow`."""
    stack, k = [_Part("")], 0

    def refuse(what: str):
        raise ValueError(f"unsupported in a regular expression: {what}")

    def item(text: str, solid: bool = True, doubling: bool = False) -> None:
        top = stack[-1]
        settle(top)
        top.out.append(text)
        top.last = (solid, doubling)

    def settle(part: _Part) -> None:
        if part.last is not None:
            part.solid += part.last[0]
            part.last = None

    def close_alternative(part: _Part) -> None:
        settle(part)
        part.alone = part.alone or part.loops and not part.solid
        part.some = part.some and part.solid > 0
        part.solid, part.loops = 0, False

    def escape(at: int, inside: bool) -> tuple[int, str, bool]:
        """(where it ends, its form, whether that is a set) of the escape that begins at `at`."""
        if at + 1 >= len(pattern):
            refuse("a backslash at the end")
        c = pattern[at + 1]
        if c in "pP":
            m = re.compile(r"\{(\^?)(\w+)\}|(\w)").match(pattern, at + 2) or refuse(pattern[at : at + 3])
            name, negated = m[2] or m[3], (c == "P") != bool(m[1])
            if name == "Any":
                return m.end(), (r"\x{0}-\x{10FFFF}" if not negated else r"&&[^\x{0}-\x{10FFFF}]") if inside else r"(?s:.)" if not negated else "(?!)", True
            known = name if len(name) <= 2 else f"Is{name}"
            return m.end(), rf"\{'P' if negated else 'p'}{{{known}}}", True
        if c in "dsw":
            return at + 2, PERL[c] if inside else f"[{PERL[c]}]", True
        if c in "DSW":
            return at + 2, f"[^{PERL[c.lower()]}]", True
        if c == "x":
            m = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})").match(pattern, at + 2) or refuse(pattern[at : at + 3])
            code = int(m[1] or m[2], 16)
            return (m.end(), _char(code), False) if code <= 0x10FFFF else refuse(m[0])
        if m := re.compile(r"0[0-7]{0,2}|[1-7][0-7]{1,2}").match(pattern, at + 1):
            return m.end(), _char(int(m[0], 8)), False
        if c in CONTROLS:
            return at + 2, _char(CONTROLS[c]), False
        if c.isascii() and not c.isalnum():
            return at + 2, _char(ord(c)), False
        refuse(pattern[at : at + 2])

    def char_class(at: int) -> tuple[int, str]:
        negated = pattern.startswith("^", at + 1)
        k, out, first = at + 1 + negated, [], True
        while k < len(pattern) and (pattern[k] != "]" or first):
            first = False
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(pattern, k):
                if m[2] not in POSIX:
                    refuse(m[0])
                out.append(f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]])
                k = m.end()
                continue
            whole = False
            if pattern[k] == "\\":
                k, low, whole = escape(k, True)
            else:
                low, k = _char(ord(pattern[k])), k + 1
            if not whole and pattern.startswith("-", k) and k + 1 < len(pattern) and pattern[k + 1] != "]":
                k, high, whole = escape(k + 1, True) if pattern[k + 1] == "\\" else (k + 2, _char(ord(pattern[k + 1])), False)
                if whole or _code(low) > _code(high):
                    refuse("a range in a class")
                low = f"{low}-{high}"
            out.append(low)
        if k >= len(pattern):
            refuse("a class without an end")
        return k + 1, f"[{'^' if negated else ''}{''.join(out)}]"

    repeated = False
    while k < len(pattern):
        c, top = pattern[k], stack[-1]
        count = COUNT.match(pattern, k) if c == "{" else None
        if c in "*+?" or count:
            k = count.end() if count else k + 1
            lazy = pattern.startswith("?", k)
            k += lazy
            if repeated or top.last is None:
                refuse(f"a repetition of nothing or of a repetition: {c}")
            low = int(count[1]) if count else int(c == "+")
            high = (int(count[3]) if count[3] else None if count[2] else low) if count else 1 if c == "?" else None
            if low > MOST or high is not None and (high > MOST or high < low):
                refuse(count[0])
            solid, doubling = top.last
            if high is None:
                if doubling:
                    refuse("a repetition of nothing but a repetition")
                top.loops = True
            top.last = (solid and low > 0 and high is not None, doubling)
            top.out.append((count[0] if count else c) + ("?" if lazy != ("U" in top.flags) else ""))
            repeated = True
            continue
        repeated = False
        if c == "\\":
            if pattern.startswith(r"\Q", k):
                end = pattern.find(r"\E", k + 2)
                for x in pattern[k + 2 : end if end >= 0 else len(pattern)]:
                    item(_char(ord(x)))
                k = end + 2 if end >= 0 else len(pattern)
                continue
            n = pattern[k + 1 : k + 2]
            if n and (n in "Az" or n in allow):
                item(f"\\{n}", False)
                k += 2
            elif n and n in "bB":
                item(EDGE if n == "b" else NO_EDGE, False)
                k += 2
            else:
                k, text, _ = escape(k, False)
                item(text)
        elif c == "[":
            k, text = char_class(k)
            item(text)
        elif c == "(":
            m = re.compile(r"\(\?P?<(\w+)>|\((?!\?)|\(\?([imsU]*)(?:-([imsU]+))?([:)])").match(pattern, k) or refuse(pattern[k : k + 4])
            flags = top.flags
            if m[4]:
                flags = "".join(sorted((set(flags) | set(m[2])) - set(m[3] or "")))
            k = m.end()
            if m[4] == ")":  # flags for the rest of the group; Java has them for case alone
                settle(top)
                if ("i" in flags) != ("i" in top.flags):
                    top.out.append("(?iu)" if "i" in flags else "(?-iu)")
                top.flags = flags
                continue
            settle(top)
            stack.append(_Part(flags))
            same = ("i" in flags) == ("i" in top.flags)
            stack[-1].out.append("(" if m[4] is None else "(?:" if same else "(?iu:" if "i" in flags else "(?-iu:")
        elif c == ")":
            if len(stack) == 1:
                refuse("a parenthesis that closes nothing")
            own = stack.pop()
            loops = own.loops
            close_alternative(own)
            item("".join(own.out) + ")", own.some, own.alone)
            stack[-1].loops = stack[-1].loops or loops or own.alone
            k += 1
        elif c == "|":
            close_alternative(top)
            top.out.append("|")
            k += 1
        elif c == "^":
            item("(?<![^\\n])" if "m" in top.flags else "^", False)
            k += 1
        elif c == "$":
            item("(?=\\n|\\z)" if "m" in top.flags else "\\z", False)
            k += 1
        elif c == ".":
            item("(?s:.)" if "s" in top.flags else "[^\\n]")
            k += 1
        else:
            item(_char(ord(c)) if c in "{}]&~#-" else c)
            k += 1
    if len(stack) > 1:
        refuse("a parenthesis without an end")
    return "".join(stack[0].out)


def _code(text: str) -> int:
    """The code point that a form of _char stands for."""
    return int(text[3:-1], 16) if text.startswith("\\x{") else ord(text)
