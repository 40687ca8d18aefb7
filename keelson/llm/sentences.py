"""Sentences of texts in any language, script and layout.

The boundary rules are compiled into a finite transducer. Its input are a text's lines, each of a class (blank, heading, line of log or
data that stands alone, list item, plain), and within them marks, quotes and brackets, each of which has a decision that only depends on
the code points near it and on whether a sentence has just begun. Its state is that of the layout (no unit is open, or one is: plain, in
a list, at a number or letter of a list) and that of the sentence (whether one has begun and where, and up to where a group is passed
over). Its output are the sentences. Reading takes time in proportion to the text.

A text is cut into chunks, each a row of its own with the context that decisions look at. The first chunk begins in the start state. A
later one doesn't know the state it begins in, so it gives its whole transition function as a table; tables are composed associatively
by a prefix scan in blocks over the chunks, which gives each chunk its entry state and so its sentences.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a chunk; it goes on to the end of its line, or to twice as many where that is too far.
CHUNK = 4096
#: Code points within which a bracket or quotation closes. One that doesn't is no group, and its marks are like any others.
GROUP = 1024
#: Code points that a chunk has as context on its sides, beyond the white space there.
SIDE = GROUP + 128
#: Chunks whose tables are composed in one step of the scan; with two levels a text has up to FAN * FAN chunks.
FAN = 512

#: Abbreviations after which a sentence goes on. Written without the last full stop, in lower case.
ALWAYS = set(
    "mr mrs ms dr prof st mt gen col capt lt sgt rev hon sen rep gov pres messrs cert certs approx esp viz cf vs v ver vers e.g i.e i.a eg ie ca c fig figs tab tabs eq eqs ch chap vol vols pp p pg ed eds al. "
    "resp incl excl max avg misc dept est ext tel nr abs ziff kap hr hrn fr frl z.b z. d.h u.a o.a o.g i.d.r i.d bzw ggf evtl inkl exkl vgl s bd anm bsp zzgl sog gem lfd abschn anh anl lt hrn z u kgl "
    "m mm mme mlle p.ex ex réf ref art al env chap éd n.b par n° no. sr sra srta srs sras dr dra d dña ud uds pág págs p.ej ej núm n.º n.ª cap aprox tel ing lic "
    "см рис табл гл стр т.е т.к т.н т.о напр им ул проф акад доц г-н г-жа ср п пп ст разд тов гр "
    "डॉ श्री पं प्रो कु sig sigg dott dott.ssa avv egr pag ecc.mo n nn dhr mevr bv o.a. nl "
    "jan feb mar apr jun jul aug sep sept oct nov dec okt dez".split()
) - {"no."}
#: Abbreviations that may also end a sentence; they do if the next word begins like one.
SOMETIMES = set(
    "etc sec sect min a.m p.m am. pm. u.s u.k u.n e.u u.s.a inc corp ltd co llc plc gmbh bros jr sr. ph.d b.a m.a usw u.s.w uvm u.v.m d.m d.j v.chr n.chr ff f "
    "мин г гг др т.д т.п пр сек час ч руб коп тыс млн млрд шт экз в.в вв н.э м км см. кг ecc".split()
)
#: Words before a number with a full stop that make it an ordinal.
BEFORE_ORDINAL = set("der die das dem den des am im vom zum zur beim ab seit bis ein eine einem einen einer jeder jede jedes dieser diese dieses unser unsere ihr ihre sein seine und oder als pro kein keine nach vor".split())
#: Names in lower case that a sentence may begin with.
NAMES = set("openssl libsodium libssl libcrypto libgcrypt mbedtls wolfssl boringssl gnutls nss bouncycastle iphone ios ebpf systemd kubectl npm pip curl git".split())
#: Words before a single capital letter that make it a label and no initial.
LABELLED = set("plan option appendix annex part type class group team tier phase section variant version case level column row step point rev site zone building vitamin grade series exhibit table figure".split())
#: Month names that follow an ordinal.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

_STRONG = "。！？｡।॥؟۔։።፧፨!?‼⁇⁈⁉．"
_ENDS = _STRONG + ".…"
_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "«": "»", "“": "”", "‘": "’", "‹": "›"}
_CLOSERS = set(")]}）］」』】》〉»”’›\"'“‘")
_QUOTES = set("「『«“‘\"„‚‹»›”")
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"


@functools.cache
def _compiled():
    import regex

    c = regex.compile
    return {
        "line": c(r"[^\n\r\x0b\x0c\x85\u2028\u2029]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]|\Z)"),
        "break": c(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"),
        "class": c(r"[^\S\n\r]*+(?:(?P<h>#{1,6}[^\S\n\r]+\S)|(?P<b>[-*+•‣◦▪·○●–—☐☑✓✔])[^\S\n\r]+(?=\S)|\(?(?P<n>\d++)[.)][^\S\n\r]+(?=\S)|\(?(?P<l>[A-Za-z])\)[^\S\n\r]+(?=\S))"),
        "mark": c(r"(?!\.[\p{L}\p{N}])[" + regex.escape(_ENDS) + r"]+|[(\[{（［「『【《〈«»“„‹\"]"),
        "pairs": c(r"[()\[\]{}（）［］「」『』【】《》〈〉«»“”„‹›]"),
        "next": c(r"[^\S]*[\"'“„«‹‘(\[「『《（¿¡]*\s*(\S\S{0,40})"),
        "thai": c(r"(?:(?<=\p{Thai})|(?<=\p{Thai}\s?[\p{Extended_Pictographic}\p{Emoji_Modifier}\u200d\ufe0f\U0001F1E6-\U0001F1FF\u2640\u2642]{1,12}))\s+(?=\p{Thai})"),
        "any thai": c(r"\p{Thai}"),
        "cjk": c(f"[{_CJK}]"),
        "spaced": c(r"(?<![\p{L}\p{N}])(\p{L}{1,3}(?:\.\s+\p{L}{1,3})+)$"),
        "before": c(r"(\p{L}+)\s+$"),
        "ja joins": c(_JA_JOINS),
        "zh joins": c(_ZH_JOINS),
        "zh says": c(_ZH_JOINS + "|" + _ZH_SAYS),
        "prose": c(r"[" + regex.escape(_ENDS) + r"][\"'”’»)\]」』）]*\s*\Z"),
    }


# ---- layout: lines and units

#: Classes of lines; CONT is the rest of a line whose beginning is in another chunk.
BLANK, OWN, BULLET, NUMBER, LETTER, TEXT, CONT = range(7)


class Chunk:
    """A chunk with its context: what of it does not depend on the state it is entered in.

    t: context, chunk from a up to b, context. off: the position of t in the text. first, last: nothing is before t, behind t. mid: the
    chunk begins within a line. solid, tail: the line cut at the chunk's beginning, at its end, is one unit.
    """

    def __init__(self, t: str, off: int, a: int, b: int, last: bool, mid: bool = False, solid: bool = False, tail: bool = False):
        self.t, self.off, self.a, self.b, self.last, self.mid, self.solid = t, off, a, b, last, mid, solid
        c = _compiled()
        self.thai = c["any thai"].search(t) is not None
        head = t[:a]
        gap = head[len(head.rstrip()) :]
        alone = not mid and ((len(gap) == a and off == 0) or sum(1 for _ in c["break"].finditer(gap)) > 1)
        rows: list[tuple[int, int, int, int, int, bool]] = []
        blank = alone  # whether the line before is blank
        spans = [m.span() for m in c["line"].finditer(t, a) if m.end() > m.start()]
        for i, (lo, hi) in enumerate(spans):
            if i == 0 and mid:
                rows.append((lo, hi, CONT, 0, lo, False))
                blank = False
                continue
            line = t[lo:hi]
            if line.isspace():
                rows.append((lo, hi, BLANK, 0, lo, False))
                blank = True
                continue
            m = c["class"].match(line)
            kind, value, body = TEXT, 0, lo
            if m is None:
                pass
            elif m["h"]:
                kind = OWN
            elif m["b"]:
                kind, body = BULLET, lo + m.end()
            elif m["n"]:
                n = m["n"]
                kind, value, body = NUMBER, int(n) if len(n) < 1000 else -1, lo + m.end()
            else:
                kind, value, body = LETTER, ord(m["l"]), lo + m.end()
            if blank and kind != OWN:
                if hi == len(t) and not last:
                    if tail and lo < b:
                        kind = OWN
                elif (i + 1 == len(spans) or t[spans[i + 1][0] : spans[i + 1][1]].isspace()) and _one_unit(line):
                    kind = OWN
            colon = kind in (BULLET, NUMBER) and t[max(0, lo - SIDE) : lo].rstrip().endswith((":", "："))
            rows.append((lo, hi, kind, value, body, colon))
            blank = False
        self.lines = rows

    def units(self, state: str) -> tuple[list[tuple[int, int, int, bool, bool]], str]:
        """Units (start, start without a list mark, end, one sentence, goes on beyond the chunk) and the exit state, entered in state.

        States: F no unit is open; T a plain one; L a bullet; N12 and A98 number 12 and letter b of a list; N and A any other number and
        letter. A unit that is open at the beginning starts at a.
        """
        out = []
        a, b, s = self.a, self.b, state
        lo0 = body0 = -1
        single = False
        if state != "F" or self.mid:
            lo0 = body0 = a
            single = self.mid and self.solid
        left = None
        for lo, hi, kind, value, body, colon in self.lines:
            if lo >= b:
                if left is None:
                    left = s
                if lo0 < 0:
                    break
            if kind == TEXT:
                if s == "F":
                    s, starts = "T", True
                else:
                    continue
            elif kind == CONT:
                if single:
                    out.append((lo0, body0, hi, True, hi > b or (hi == len(self.t) and not self.last)))
                    lo0, single, s = -1, False, "F"
                continue
            elif kind == BLANK or kind == OWN:
                if lo0 >= 0:
                    out.append((lo0, body0, lo, False, lo > b))
                    lo0 = -1
                if kind == OWN and lo < b:
                    out.append((lo, lo, hi, True, hi > b))
                s = "F"
                continue
            else:
                s, starts = _step(s, kind, value, colon)
                if not starts and lo0 >= 0:
                    continue
                if not starts:
                    body = lo
            if lo0 >= 0:
                out.append((lo0, body0, lo, False, lo > b))
                lo0 = -1
            if lo >= b:
                break
            lo0, body0 = lo, body
        if lo0 >= 0:
            end = len(self.t)
            out.append((lo0, body0, end, False, end > b or not self.last))
        return out, s if left is None else left


def _step(s: str, kind: int, value: int, colon: bool) -> tuple[str, bool]:
    """The layout's state after a list mark, and whether the mark begins a unit; otherwise it is text."""
    fresh, listed = s == "F", s[0] in "LNA"
    if kind == BULLET:
        starts, to = fresh or listed or colon, "L"
    elif kind == NUMBER:
        # a number of four digits with none before it may be a year
        starts, to = ((fresh or (colon and value <= 1)) and 0 <= value < 1000) or s == f"N{value - 1}", f"N{value}"
    else:
        starts, to = fresh or s == f"A{value - 1}", f"A{value}"
    return (to if starts else "T" if fresh else s), starts


def segment(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence of text, without white space around it, in order."""
    return read(Chunk(text, 0, 0, len(text), True), START)


def _one_unit(line: str) -> bool:
    """Whether a line that stands alone is a heading or a line of log, data or code."""
    s = line.strip()
    c = _compiled()
    m = c["class"].match(line)
    if m and (m["h"] or m["b"]):
        return bool(m["h"])
    if sum(map(str.isalpha, s)) * 3 < len(s) - s.count(" ") and not c["prose"].search(s):
        return True
    return bool(_log().match(s))


@functools.cache
def _log():
    import regex

    return regex.compile(
        r"\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|<\d+>|(?:error|warning|warn|info|debug|note|fatal|trace|panic|critical)(?:\[[^\]]*\])?:\s|(?:ERROR|WARN|WARNING|INFO|DEBUG|FATAL|TRACE)\b|\$ |>>> |#!|at [\w.$]+\(|Traceback |File \"|"
        r"[\w.-]+@[\w.-]+[:~]|\{.*[:;].*\}?\s*$|\w[\w.]*\s*=\s*\S+;?$|(?:if|for|while|return|switch|def|class|func|import|from|const|static|public|private|void|int|char|var|let|SELECT|INSERT)\b.*[;{}:)]\s*$|[\w.:>-]+\(.*\);?\s*$|(?:[^\s,;|]+[,;|\t]\s?){3,}[^\s,;|]*$|[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){3,}|0x[0-9a-fA-F]+[: ]"
    )


# ---- sentences within units


def _skip(text: str, at: int, hi: int) -> int:
    while at < hi and text[at].isspace():
        at += 1
    return at


_CLOSES: dict[str, str] = {}
for _o, _c in [*_OPEN.items(), ("„", "“"), ("„", "”"), ("»", "«")]:
    _CLOSES[_c] = _CLOSES.get(_c, "") + _o


def _matches(t: str, lo: int, hi: int) -> dict[int, int]:
    """Opening marks in t[lo:hi] with what closes them there, by one stack for each kind of mark."""
    stacks: dict[str, list[int]] = {}
    out = {}
    for m in _compiled()["pairs"].finditer(t, lo, hi):
        ch, at = m[0], m.start()
        for o in _CLOSES.get(ch, ""):
            if stacks.get(o):
                p = stacks[o].pop()
                if at - p <= GROUP:
                    out[p] = at
        if ch in _OPEN or ch in "„»":
            stacks.setdefault(ch, []).append(at)
    return out


def _pair(text: str, at: int, fresh: bool, hi: int, matches: dict[int, int]) -> tuple[int, bool]:
    """Where to go on after an opening quote or bracket, and whether a sentence ends there; fresh: one has just begun."""
    o = text[at]
    if o == '"':
        if not fresh and text[at - 1].isalnum():
            return at + 1, False
        close = text.find('"', at + 1, min(hi, at + 1 + GROUP))
    elif o == "»" and not fresh and not text[at - 1].isspace():
        return at + 1, False
    else:
        close = matches.get(at, -1)
    if close < 0:
        return at + 1, False
    inner = text[at + 1 : close].rstrip()
    after = _after(text, close + 1, hi, bool(inner) and ord(inner[-1]) > 0x2FFF)
    ended = bool(inner) and inner[-1] in _ENDS and not _abbreviated(inner)
    if o in "([{（［":
        return (at + 1 if fresh and ended else close + 1), False  # sentences inside count by themselves
    if not ended:
        return close + 1, False
    end = _closed(text, close + 1, hi)
    lead = "" if fresh else text[max(0, at - 64) : at].rstrip()
    if after == "goes on" or (after == "cjk" and _cjk_goes_on(text, end, hi, lead)):
        return close + 1, False
    if fresh:
        return at + 1, False  # a quotation of its own: what is inside counts by itself
    if after in ("ends", "new", "cjk"):
        return end, True
    return close + 1, False


def _after(text: str, at: int, hi: int, wide: bool) -> str:
    """What follows a closed group: ends (nothing), new (a new sentence), goes on, or cjk (a script without spaces)."""
    at = _closed(text, at, hi)
    if at >= hi:
        return "ends"
    ch = text[at]
    if not ch.isspace():
        return "cjk" if wide and (ch.isalnum() or ch in "「『“（《‘" or _compiled()["cjk"].match(ch)) else "goes on"
    at = _skip(text, at, hi)
    if at >= hi:
        return "ends"
    ch = text[at]
    if ch in "—–-,;:،؛、，；)":
        return "goes on"
    if ch.islower():
        return "new" if _named(text[at : at + 40]) else "goes on"
    return "cjk" if wide else "new"


def _named(word: str) -> bool:
    """Whether a word in lower case may begin a sentence: a name, or something like an identifier."""
    word = word.split()[0].rstrip(".,;:!?") if word.split() else ""
    return word in NAMES or any(x.isdigit() or x in "-_/" for x in word)


#: How a Chinese or Japanese sentence goes on after a quotation.
_ZH_SAYS = r"(?:他|她|它|他们|她们|我|有人|[\p{Han}]{1,4}?)(?:又|便|就|还|曾)?(?:问|说|写|喊|答|道|表示|回答|指出|强调|补充)"
_ZH_JOINS = r"(?:但|而|却|可是|不过|然而|并|所以|因此|于是|然后|接着|的|这|是)"
_JA_JOINS = r"(?:と|という|って|の|は|が|を|に|で|も|や|など|から|まで|より|、)"


def _cjk_goes_on(text: str, at: int, hi: int, lead: str) -> bool:
    c = _compiled()
    rest = text[at : at + 12]
    if c["ja joins"].match(rest):
        return True
    if lead.endswith(("：", ":", "，")):
        return bool(c["zh joins"].match(rest))
    return bool(c["zh says"].match(rest))


def _word(text: str, end: int) -> str:
    """The word, of letters, digits and what joins them, that ends at end; of a long one the last 40 code points."""
    at, least = end, max(0, end - 40)
    while at > least:
        ch = text[at - 1]
        if not (ch.isalnum() or ch in ".'’°º-" or (ch > "\x7f" and unicodedata.category(ch)[0] == "M")):
            break
        at -= 1
    return text[at:end]


def _abbreviated(inner: str) -> bool:
    """Whether the full stop at the end of inner is that of an abbreviation."""
    if inner[-1] != ".":
        return False
    word = _word(inner, len(inner) - 1).lower()
    return word in ALWAYS or word in SOMETIMES


def _ends(text: str, start: int, end: int, fresh: bool, hi: int) -> int:
    """The end of the sentence if the marks at start end one, else 0; fresh: a sentence has just begun."""
    c = _compiled()
    marks, stop = text[start:end], end
    if fresh and not any(x in _STRONG for x in marks):
        return 0
    end = _closed(text, end, hi)
    if end < hi and text[end] in " \u00a0\u202f" and text[end + 1 : end + 2] in ("»", "›"):
        near = max(0, end - GROUP)
        if text.rfind("«", near, end) > text.rfind("»", near, end):
            end += 2
    if end < hi and text[end] in _ENDS:
        return 0  # the last of them decides
    nxt = c["next"].match(text, end, hi)
    word = nxt.group(1) if nxt else ""
    spaced = end >= hi or text[end].isspace()
    strong = [x for x in marks if x in _STRONG]
    if strong and all(x in "!?" for x in strong):
        wide = False
    else:
        wide = bool(strong)
    if wide:
        if ord(strong[-1]) > 0x2FFF or strong[-1] in "।॥؟۔։።፧፨":
            return end
    if marks[0] == "…" and not strong:
        if set(marks) == {"…"} and not spaced:
            return 0
        return end if spaced and (not word or not word[0].islower() or _named(word)) else 0
    if not spaced:
        return end if strong and c["cjk"].match(text[end]) else 0
    if strong:
        if not word:
            return end
        if word[0].islower() and not _named(word):
            return 0
        return 0 if word[0] in "—–,;" else end
    # full stops
    if not word:
        return end
    if len(marks) > 1:  # an ellipsis
        return 0 if word[0].islower() and not _named(word) else end
    if word[0] in ",;:—–،؛)":
        return 0
    before = _word(text, start)
    bare = before.lower().lstrip("'’-")
    if end > stop and before.isdigit() and text[stop] == ")":
        near = max(0, start - GROUP)
        if text.count("(", near, start) <= text.count(")", near, start):
            return 0  # 1.) in a line
    if not before:
        return end
    spaced_abbreviation = _spaced(text, start)
    if bare in ALWAYS and not (len(bare) > 1 and end > stop):
        return 0
    if len(before) == 1 and before.islower() and len(word) == 2 and word[0].isalpha() and word[1] == ".":
        return 0  # the first of letters with stops and spaces between
    if bare in SOMETIMES or spaced_abbreviation in SOMETIMES:
        return end if _begins(word) else 0
    if spaced_abbreviation in ALWAYS:
        return 0
    if len(before) == 1 and before.isalpha() and before.isupper() and end == stop:
        prev = text[max(0, start - 65) : start - 1].split()
        return 0 if word[0].isupper() and not (prev and prev[-1].lower() in LABELLED) else end
    if len(before) == 1 and before.islower() and word[0].islower():
        return 0
    if "." in before and all(len(x) <= 1 for x in bare.split(".")) and bare.replace(".", "").isalpha():
        return end if _begins(word) else 0  # letters with stops
    if bare in ("no", "nos") and word[0].isdigit():
        return 0
    if before.isdigit() and len(before) <= 2 and _ordinal(text, start - len(before), word):
        return 0
    return end


def _opens(text: str, at: int, hi: int) -> bool:
    """Whether the quote at at, which may open or close, opens."""
    return text[at] in "“‘»›" and at + 1 < hi and text[at + 1].isalnum() or text[at] in "\"'" and at + 1 < hi and text[at + 1].isalnum()


def _closed(text: str, at: int, hi: int) -> int:
    """at moved over the closing quotes and brackets there."""
    while at < hi and text[at] in _CLOSERS and not _opens(text, at, hi):
        at += 1
    return at


def _spaced(text: str, at: int) -> str:
    """Letters with stops and spaces between, as d. M. or т. е., before at: without the spaces, in lower case.

    A capital letter after a word it labels, as in plan B., is none of them.
    """
    near = text[max(0, at - 16) : at]
    m = _compiled()["spaced"].search(near) if "." in near else None
    if not m:
        return ""
    letters = m.group(1).split()
    begin = max(0, at - 16) + m.start()
    label = text[max(0, begin - 40) : begin].split()[-1:]
    if len(letters[0]) == 2 and letters[0][0].isupper() and label and label[0].lower() in LABELLED:
        letters = letters[1:]
    return "".join(letters).lower() if len(letters) > 1 else ""


def _begins(word: str) -> bool:
    """Whether word begins like a sentence."""
    return word[0].isupper() or word[0] in "¿¡#\"“«„(" or (word[0].isalpha() and not word[0].islower())


def _ordinal(text: str, at: int, word: str) -> bool:
    prev = _compiled()["before"].search(text[max(0, at - 40) : at])
    if word[0].islower() or word.strip(".,;:").lower() in MONTHS:
        return word.strip(".,;:").lower() in MONTHS or prev is not None and (prev.group(1).lower() in BEFORE_ORDINAL or not _named(word))
    return prev is not None and prev.group(1).lower() in BEFORE_ORDINAL


# ---- the transducer

#: A state: that of the layout, the position up to which text has been passed over, whether a sentence's own text begins there, and
#: where the sentence does (-1: at that position if it begins, else the same place as in the state before).
START = ("F", 0, True, -1)


def _events(chunk: Chunk, body: int, hi: int) -> list[tuple[int, int, int]]:
    """Start, end and kind (0 end marks, 1 an opening mark, 2 a gap of Thai) of what may matter in a unit, up to the chunk's end."""
    t, stop = chunk.t, min(hi, chunk.b)
    out = [(m.start(), m.end(), 0 if t[m.start()] in _ENDS else 1) for m in _compiled()["mark"].finditer(t, body, hi) if m.start() < stop]
    if chunk.thai:
        gaps = [(m.start(), m.end(), 2) for m in _compiled()["thai"].finditer(t, body, hi) if m.start() < stop]
        if gaps:
            out = sorted(out + gaps)
    return out


class Unit:
    """The decisions of a unit, each taken once at most."""

    def __init__(self, chunk: Chunk, lo: int, body: int, hi: int):
        self.t, self.hi, self.lo, self.body = chunk.t, hi, lo, body
        self.events = _events(chunk, body, hi)
        self.matches: dict[int, int] | None = None

    def decide(self, i: int, fresh: bool) -> tuple[int, int]:
        """Where to go on after an event, and the end of the sentence if it ends one, else -1."""
        start, end, kind = self.events[i]
        if kind == 0:
            stop = _ends(self.t, start, end, fresh, self.hi)
            return (stop, stop) if stop else (end, -1)
        if kind == 2:
            return end, start
        if self.matches is None:
            self.matches = _matches(self.t, self.body, self.hi)
        go, ended = _pair(self.t, start, fresh, self.hi, self.matches)
        return go, go if ended else -1


def read(chunk: Chunk, state: tuple[str, int, bool, int]) -> list[tuple[int, int]]:
    """The sentences that end in a chunk entered in state."""
    layout, at, begins, began = state
    t, off, b = chunk.t, chunk.off, chunk.b
    units, _ = chunk.units(layout)
    out: list[tuple[int, int]] = []

    def put(lo: int, hi: int) -> None:
        while lo < hi and lo >= 0 and t[lo].isspace():
            lo += 1
        while hi > lo and hi > 0 and t[hi - 1].isspace():
            hi -= 1
        if hi > lo:
            out.append((lo + off, hi + off))

    open_before = layout != "F" or chunk.mid
    for i, (lo, body, hi, single, more) in enumerate(units):
        start, pos = lo, body
        first = -1
        if i == 0 and open_before:
            pos = max(body, at - off)
            start = pos if begins and began < 0 else began - off
            first = pos if begins else -1
        if single:
            if not more:
                put(start, hi)
            continue
        unit = Unit(chunk, lo, body, hi)
        events = unit.events
        if first < 0 and not (i == 0 and open_before):
            first = _skip(t, body, hi)
        for k in range(len(events)):
            e = events[k][0]
            if e < pos:
                continue
            pos, ended = unit.decide(k, e <= first)
            if ended >= 0:
                put(start, ended)
                start = first = _skip(t, max(ended, pos), hi)
        if not more and start < hi:
            put(start, hi)
    return out


def table(chunk: Chunk) -> dict:
    """The transition function of a chunk over all states, as a table.

    by: classes of layout states with their row; rows: the layout's exit state (= the same as entered), and either the exit (at, begins,
    began) whatever the state of the sentence is (x), or for each position up to which text may have been passed over the exits if a
    sentence doesn't begin there and if it does (at, to). end: where the chunk ends.
    """
    classes = ["F", "T", "L", "N", "A"]
    for _, _, kind, value, _, _ in chunk.lines:
        if kind in (NUMBER, LETTER):
            classes.append(f"{'N' if kind == NUMBER else 'A'}{value - 1}")
    by, rows, known = {}, [], {}
    for c in dict.fromkeys(classes):
        units, left = chunk.units(c)
        last = units[-1] if units else None
        key = (left if left != c else "=", last, len(units) == 1)
        if key not in known:
            known[key] = len(rows)
            rows.append({"l": key[0], **_exits(chunk, last, c != "F" or chunk.mid, len(units))})
        by[c] = known[key]
    return {"end": chunk.off + chunk.b, "by": by, "rows": rows}


def _exits(chunk: Chunk, last: tuple[int, int, int, bool, bool] | None, entered: bool, n: int) -> dict:
    off, b, t = chunk.off, chunk.b, chunk.t
    end = off + b
    if last is None or not last[4]:
        return {"x": [end, True, -1]}
    lo, body, hi, single, _ = last
    inherits = n == 1 and entered  # the unit was open before the chunk
    if single:
        return {"at": [end], "to": [[[end, False, -1]] * 2]} if inherits else {"x": [end, False, off + lo]}
    unit = Unit(chunk, lo, body, hi)
    starts = [e[0] for e in unit.events]
    m = len(starts)
    to: list = [None] * m + [[[end, False, -1]] * 2]  # nothing more: the sentence goes on

    def begun(at: int) -> list:
        """The exit of a sentence that begins behind at."""
        at = _skip(t, at, hi)
        if at >= b:
            return [off + at, True, -1]
        k = bisect_left(starts, at)
        pos, begins, began = to[k][k < m and starts[k] == at]
        return [pos, begins, began if began >= 0 or begins else off + at]

    for i in range(m - 1, -1, -1):
        both = []
        for fresh in (False, True):
            go, ended = unit.decide(i, fresh)
            if ended >= 0:
                both.append(begun(max(go, ended)))
            elif go >= b:
                both.append([off + go, False, -1])
            else:
                both.append(to[bisect_left(starts, go)][0])
        to[i] = both
    if not inherits:
        at = _skip(t, body, hi)
        if at >= b:
            return {"x": [off + at, True, off + lo]}
        k = bisect_left(starts, at)
        pos, begins, began = to[k][k < m and starts[k] == at]
        return {"x": [pos, begins, began if began >= 0 or begins else off + lo]}
    return {"at": [off + e for e in starts] + [end - 1], "to": to}


def _row(table: dict, layout: str) -> dict:
    by = table["by"]
    return table["rows"][by[layout] if layout in by else by[layout[0]]]


def apply(table: dict, state: tuple[str, int, bool, int]) -> tuple[str, int, bool, int]:
    """The exit state of a chunk, or of neighbouring ones, entered in state."""
    layout, at, begins, began = state
    row = _row(table, layout)
    left = layout if row["l"] == "=" else row["l"]
    if "x" in row:
        return (left, *row["x"])
    if at >= table["end"]:
        return left, at, begins, began
    k = bisect_left(row["at"], at)
    pos, to_begin, place = row["to"][k][begins and row["at"][k] == at]
    return left, pos, to_begin, place if place >= 0 or to_begin else began if began >= 0 or not begins else at


def compose(a: dict, b: dict) -> dict:
    """The table of two neighbours; associative."""
    by, rows = {}, []
    through = [c for c in b["by"] if len(c) > 1 and a["rows"][a["by"][c[0]]]["l"] == "="]
    for c in dict.fromkeys([*a["by"], *through]):
        row = _row(a, c)
        mid = c if row["l"] == "=" else row["l"]
        then = _row(b, mid)
        left = row["l"] if then["l"] == "=" else then["l"]
        if "x" in then:
            new = {"l": left, "x": then["x"]}
        elif "x" in row:
            new = {"l": left, "x": list(apply(b, (mid, *row["x"]))[1:])}
        else:
            new = {"l": left, "at": row["at"] + then["at"], "to": [[list(apply(b, (mid, *e))[1:]) for e in both] for both in row["to"]] + then["to"]}
        by[c] = len(rows)
        rows.append(new)
    return {"end": b["end"], "by": by, "rows": rows}


# ---- documents


def cut(text: str, chunk: int = CHUNK) -> list[tuple[int, int, bool, bool, bool]]:
    """Chunks of text: start, end, whether it begins within a line, and whether the lines cut at its start and end are one unit.

    Chunks end at line ends; a line that goes on too far is cut between letters or blanks.
    """
    c, out, at, mid, solid, line = _compiled(), [], 0, False, False, 0
    n = len(text)
    while n - at > chunk:
        end = at + chunk
        m = c["break"].search(text, end, min(n, end + chunk))
        stop = -1
        if m:
            end = m.end()
        else:
            if n - end <= chunk:
                break
            end += chunk
            while end < n and (text[end - 1] in _UNCUT or text[end] in _UNCUT):
                end += 1
            stop = end if text[end - 1] not in _BREAKS else -1
        if text[end - 1] == "\r" and text[end : end + 1] == "\n":
            end += 1
        if end >= n:
            break
        if stop < 0:
            out.append((at, end, mid, solid, False))
            at, mid, solid, line = end, False, False, end
            continue
        begin = max(line, max(text.rfind(x, at, end) for x in _BREAKS) + 1)
        if begin != line or not (mid and solid):
            m = c["break"].search(text, end)
            own = text[begin : m.end() if m else n]
            gap = text[len(text[:begin].rstrip()) : begin]
            alone = begin == len(gap) or sum(1 for _ in c["break"].finditer(gap)) > 1
            if alone and m and m.end() < n:
                after = c["break"].search(text, m.end())
                alone = text[m.end() : after.end() if after else n].isspace()
            cls = c["class"].match(own)
            whole = bool(cls and cls["h"]) or (alone and _one_unit(own))
        else:
            whole = solid
        out.append((at, end, mid, solid, whole))
        at, mid, solid, line = end, True, whole, begin
    out.append((at, n, mid, solid, False))
    return out


_BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"
_UNCUT = frozenset(_ENDS) | _CLOSERS | set(_OPEN) | _QUOTES


def view(text: str, span: tuple[int, int, bool, bool, bool]) -> tuple[str, int, int, int, bool, bool, bool, bool]:
    """The arguments of Chunk for a span of text: with its context, which ends with something else than white space."""
    lo, hi, mid, solid, tail = span
    left = max(0, len(text[:lo].rstrip()) - SIDE) if lo else 0
    right = hi
    n = len(text)
    while right < n and text[right].isspace():
        right += 1
    right = min(n, right + SIDE)
    while right < n and text[right - 1].isspace():
        right += 1
    return text[left:right], left, lo - left, hi - left, right == n, mid, solid, tail


_CHUNK = "t string, off int, a int, b int, last boolean, mid boolean, solid boolean, tail boolean"
_FIELDS = ["t", "off", "a", "b", "last", "mid", "solid", "tail"]


def _chunk(*row) -> Chunk:
    t, off, a, b, last, mid, solid, tail = row
    return Chunk(t, int(off), int(a), int(b), bool(last), bool(mid), bool(solid), bool(tail))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """key, start_pos, end_pos: one row for each sentence of each row's text, positions in code points; key must be unique.

    Null, empty and blank texts have no rows. Texts of any length are read whole: every text's first chunk from the start state, its
    further chunks from the states that the scan gives them.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0)
    kind = dict(rows.dtypes)["k"]
    schema = f"k {kind}, start_pos int, end_pos int"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = []
            for k, t in zip(pdf["k"], pdf["t"]):
                c = _chunk(*view(t, cut(t, chunk)[0])) if len(t) > chunk else Chunk(t, 0, 0, len(t), True)
                spans += [(k, a, b) for a, b in read(c, START)]
            yield pd.DataFrame(spans, columns=["k", "start_pos", "end_pos"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, t in zip(pdf["k"], pdf["t"]):
                spans = cut(t, chunk)
                if len(spans) > 1:
                    yield pd.DataFrame([(k, i, *view(t, s)) for i, s in enumerate(spans)], columns=["k", "part", *_FIELDS])

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [json.dumps(table(_chunk(*row))) for row in zip(*[pdf[c] for c in _FIELDS])]
            yield pd.DataFrame({"k": pdf["k"], "part": pdf["part"], "f": pd.Series(found, dtype=object)})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [(k, a, b) for k, state, *row in zip(pdf["k"], pdf["entry"], *[pdf[c] for c in _FIELDS]) for a, b in read(_chunk(*row), tuple(json.loads(state)))]
            yield pd.DataFrame(spans, columns=["k", "start_pos", "end_pos"])

    heads = rows.mapInPandas(first, schema)
    chunks = rows.filter(F.length("t") > chunk).mapInPandas(split, f"k {kind}, part int, {_CHUNK}").repartition("k", "part")
    entries = scanned(chunks.mapInPandas(tables, f"k {kind}, part int, f string"), kind)
    rest = chunks.join(entries, ["k", "part"]).select("k", "entry", *_FIELDS).mapInPandas(emit, schema)
    return heads.unionByName(rest).select(F.col("k").alias(key), "start_pos", "end_pos")


def scanned(tables: DataFrame, kind: str) -> DataFrame:
    """k, part, entry: the state that each part of k but the first is entered in, of k, part and the table f of each part.

    A blocked prefix scan: blocks of FAN parts are composed, then the blocks of a text give each block its state, then each block its
    parts. No task holds more than FAN tables at a time.
    """
    of = F.array_sort(F.collect_list(F.struct("part", "f")))
    blocks = tables.groupBy("k", F.expr(f"part DIV {FAN}").cast("int").alias("block")).agg(of.alias("fs"))

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [json.dumps(functools.reduce(compose, [json.loads(f["f"]) for f in fs])) for fs in pdf["fs"]]
            yield pd.DataFrame({"k": pdf["k"], "part": pdf["block"], "f": pd.Series(found, dtype=object)})

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, start, fs in zip(pdf["k"], pdf["start"], pdf["fs"]):
                state = tuple(json.loads(start)) if start is not None else START
                for f in fs:
                    if state is not START:  # the first part is entered so, and only that
                        out.append((k, int(f["part"]), json.dumps(state)))
                    state = apply(json.loads(f["f"]), state)
            yield pd.DataFrame(out, columns=["k", "part", "entry"])

    schema = f"k {kind}, part int, entry string"
    tops = blocks.mapInPandas(total, f"k {kind}, part int, f string").groupBy("k").agg(of.alias("fs")).filter(F.size("fs") > 1)
    starts = tops.withColumn("start", F.lit(None).cast("string")).mapInPandas(states, schema).select("k", F.col("part").alias("block"), F.col("entry").alias("start"))
    # a text of one block is entered in the start state
    return blocks.join(starts, ["k", "block"], "left").select("k", "start", "fs").mapInPandas(states, schema)
