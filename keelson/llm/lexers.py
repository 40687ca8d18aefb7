"""Lexers whose chunks compose: what a chunk does to each lexer state it may be entered in.

A chunk begins at the start of a line. At such a place a lexer is in code, in a block comment, or in a string that spans lines; strings
and comments of one line have ended. So a chunk is a small map from entry states to exit states, each with a bracket summary, the
closing brackets it leaves open to its left and the opening ones to its right. Maps and summaries compose associatively.
"""

from __future__ import annotations

import functools
import re

#: Language by suffix in lower case.
LANGUAGE = {".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".java": "java", ".go": "go", ".py": "python", ".json": "json"}
#: States besides code in which a line may begin, by language; a C++ raw string has its delimiter in its state.
STATES = {"c": ("code", "comment"), "cpp": ("code", "comment"), "java": ("code", "comment", "text"), "go": ("code", "comment", "raw")}

_C_OPS = r"<<=|>>=|\.\.\.|->\*|<=>|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|##|::|\.\*|[-+*/%&|^~!<>=?:;,.(){}\[\]#]"
_NUMBER = r"(?:0[xX][0-9a-fA-F'_.]+(?:[pP][+-]?\d+)?|0[bB][01'_]+|\d[\d'_]*\.?[\d'_]*(?:[eE][+-]?\d[\d_]*)?|\.\d[\d'_]*(?:[eE][+-]?\d[\d_]*)?)\w*"
_ID = r"[^\W\d]\w*"


@functools.cache
def pattern(lang: str, directives: bool = True) -> re.Pattern:
    """The master pattern of a language's code state: white space, then one token, so that its matches follow each other without gaps.

    Groups: i name, o operator, n number, s string, h character, l line break, d directive, c comment, t string over lines, x what
    fits nothing; within c and t, open_* is what is open at the end. White space at the end is no group.
    """
    comment = r"(?P<c>//[^\n\r]*|/\*(?:[^*]++|\*(?!/))*(?:\*/|(?P<open_comment>\Z)))"
    if lang in ("c", "cpp"):
        comment = r"(?P<c>//(?:[^\n\r\\]++|\\\r?\n|\\.|\\)*|/\*(?:[^*]++|\*(?!/))*(?:\*/|(?P<open_comment>\Z)))"
        raw = r"|(?P<t>(?:u8|[uUL])?R\"(?P<delim>[^()\\\s\"]{0,16})\((?:(?!\)(?P=delim)\").)*?(?:\)(?P=delim)\"|(?P<open_raw>\Z)))" if lang == "cpp" else ""
        # a directive reaches to the end of its line, over continued lines and comments
        directive = r"|(?P<d>(?:\#|%:)(?:[^\n\r\\/\"']++|\\\r?\n|\\.|/\*(?:[^*]|\*(?!/))*\*/|//[^\n\r]*|/(?![/*])|\"(?:[^\"\\\n\r]|\\.|\\\r?\n)*\"|'(?:[^'\\\n\r]|\\.)*'|[\"'])*)" if directives else ""
        space = r"(?:\s++|\\\r?\n)*"
        name = r"(?P<i>(?:\\u[0-9a-fA-F]{4}|[^\W\d]|\$)(?:\w++|\\u[0-9a-fA-F]{4}|\$)*)"
        body = rf"{raw[1:] + '|' if raw else ''}(?P<s>(?:u8|[uUL])?\"(?:[^\"\\\n\r]++|\\\r?\n|\\.)*\"\w*)|(?P<h>(?:u8|[uUL])?'(?:[^'\\\n\r]|\\\r?\n|\\.)+')|{name}|(?P<n>{_NUMBER})|{comment}{directive}|(?P<o>{_C_OPS})"
    elif lang == "java":
        space = r"[ \t\f\r\n\x1a]*"
        body = rf"(?P<i>(?:[^\W\d]|\$)(?:\w++|\$)*)|(?P<n>{_NUMBER})|{comment}|(?P<t>\"\"\"[ \t\f]*(?:\r\n|\n|\r)(?:[^\"\\]++|\\.|\"(?!\"\"))*(?:\"\"\"|(?P<open_text>\Z)))|(?P<s>\"(?:[^\"\\\n\r]++|\\(?:[btnfrs0-7\"'\\]|u+[0-9a-fA-F]{{4}}))*\")|(?P<h>'(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{{1,2}}|u+[0-9a-fA-F]{{4}}))')|(?P<o>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|<<|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^~!<>=?:;,.(){{}}\[\]@])"
    else:
        space = r"[ \t\r]*"
        comment = comment.replace("[^\\n\\r]*", "[^\\n]*", 1)
        body = rf"(?P<l>\n)|(?P<i>{_ID})|(?P<n>{_NUMBER})|{comment}|(?P<t>`[^`]*(?:`|(?P<open_raw>\Z)))|(?P<s>\"(?:[^\"\\\n]++|\\(?:[abfnrtv\\\"]|[0-7]{{3}}|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}))*\")|(?P<h>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{{3}}|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}))')|(?P<o><<=|>>=|&\^=|\.\.\.|&\^|<-|\+\+|--|<<|>>|<=|>=|==|!=|:=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^~!<>=:;,.(){{}}\[\]])"
    return re.compile(rf"{space}(?:{body}|(?P<x>.)|\Z)", re.DOTALL)


_ENDS = {"comment": "*/", "raw": "`"}


def _leave(text: str, state: str) -> int:
    """Where code begins in a chunk entered in state, or -1."""
    if state == "text":
        m = re.match(r"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"", text, re.DOTALL)
        return m.end() if m else -1
    end = f"){state[4:]}\"" if state.startswith("raw:") else _ENDS[state]
    at = text.find(end)
    return at + len(end) if at >= 0 else -1


def lex(lang: str, text: str, state: str = "code", directives: bool = True) -> tuple[list[tuple[str, str]], str]:
    """Tokens (kind, text) of a chunk entered in state, and the state it leaves; kinds are the groups of pattern.

    Comments and spaces are left out, in Go a line break is a token, as is in C a directive. A string over lines is of kind s.
    """
    at = 0
    if state != "code":
        at = _leave(text, state)
        if at < 0:
            return [], state
    out: list[tuple[str, str]] = []
    put = out.append
    if state not in ("code", "comment"):
        put(("s", '"long"'))  # the string that ended here is a token of this chunk
    elif state == "comment" and lang == "go":
        put(("l", "\n"))
    find, special, known = pattern(lang, directives).finditer, _SPECIAL[lang], _lines[lang, directives]
    n = len(text)
    while at < n:
        end = text.find("\n", at) + 1 or n
        line = text[at:end]
        same = known.get(line)
        if same is not None:
            out += same
            at = end
            continue
        before = len(out)
        for m in find(text, at):
            kind = m.lastgroup
            if kind is None or m.start(kind) >= end:
                break
            if kind in _PLAIN:
                put((kind, m[kind]))
            elif kind == "d":
                here = m.start("d")
                put(("d", m["d"]) if not text[text.rfind("\n", 0, here) + 1 : here].strip() else ("x", "#"))
            elif kind == "c":
                if m["open_comment"] is not None:
                    return out, "comment"
                if lang == "go" and "\n" in m["c"]:
                    put(("l", "\n"))
            elif lang == "java":
                if m["open_text"] is not None:
                    return out, "text"
                put(("s", '"long"'))
            else:
                if m["open_raw"] is not None:
                    return out, f"raw:{m['delim']}" if lang == "cpp" else "raw"
                put(("s", '"long"'))
            if m.end() > end:  # it went on over line ends
                end = m.end() if text[m.end() - 1] == "\n" else text.find("\n", m.end()) + 1 or n
        if end - at == len(line) <= 200 and not special(line):
            if len(known) >= 50_000:
                known.clear()
            known[line] = out[before:]
        at = end
    return out, "code"


#: What a line must not have for its tokens to be a function of the line alone, and the tokens of such lines met before.
_SPECIAL = {lang: re.compile(r"/\*|\\\s*$" + more).search for lang, more in (("c", "|#|%:"), ("cpp", '|#|%:|R"'), ("java", '|"""'), ("go", "|`"))}
_lines: dict = {(lang, d): {} for lang in STATES for d in (True, False)}
_PLAIN = frozenset("ionshlx")


#: Brackets.
PAIRS = {")": "(", "]": "[", "}": "{"}


def summary(tokens: list[tuple[str, str]]) -> tuple[str, str, bool]:
    """The closing brackets without an opening one before, the opening ones without a closing one after, and whether a pair mismatches."""
    closing: list[str] = []
    opened: list[str] = []
    for kind, t in tokens:
        if kind != "o":
            continue
        if t in "([{":
            opened.append(t)
        elif t in PAIRS:
            if not opened:
                closing.append(t)
            elif opened.pop() != PAIRS[t]:
                return "", "", True
    return "".join(closing), "".join(opened), False


def chunk_map(lang: str, text: str, entries: tuple[str, ...] | None = None) -> dict[str, list]:
    """entry state, each of the language or of entries, to [exit state, closing, opening, mismatched]."""
    out = {}
    for state in entries or STATES[lang]:
        tokens, left = lex(lang, text, state)
        out[state] = [left, *summary(tokens)]
    return out


def compose(a: dict[str, list], b: dict[str, list]) -> dict[str, list]:
    """The map of two neighbouring chunks; associative. Where b lacks the state that a leaves, the exit state is None."""
    out = {}
    for state, (mid, c1, o1, bad1) in a.items():
        then = b.get(mid) if mid is not None else None
        if then is None:
            out[state] = [None, "", "", bad1]
            continue
        left, c2, o2, bad2 = then
        k = min(len(o1), len(c2))
        wrong = any(PAIRS[c] != o for c, o in zip(c2[:k], reversed(o1[len(o1) - k :])))
        bad = bad1 or bad2 or wrong
        out[state] = [left, "", "", True] if bad else [left, c1 + c2[k:], o1[: len(o1) - k] + o2, False]
    return out
