"""Sentence boundaries across languages and scripts.

Boundary rules are compiled into a finite transducer. A lexer turns text into few
events - marks that may end a sentence, brackets and quotation marks, blank lines - and
classes of what surrounds them: of the word or number before a point, found by a trie of
abbreviations walked backwards from it, of the word before that, and of what follows. The
rules are a table over these classes; the first that matches a combination of classes
makes it a symbol that ends a sentence or one that doesn't. The transducer's states are
the open brackets and quotes, whether a quote opened its unit, and whether a unit has just
begun. Long documents are cut into chunks: each chunk is a function from states to states,
the functions are composed by a parallel prefix scan, and each chunk then emits its
boundaries from its known first state. A chunk is read with some text around it; where
that, or two open levels, don't suffice to tell an event's classes, the whole text is run.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from enum import IntFlag, auto
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.functions.columns import pick
from gridloom.session import cut, spread

#: Characters of a chunk, and with how many before and after it is read.
CHUNK, LEFT, RIGHT = 8192, 256, 2048
#: A closing mark is sought in so many characters first; beyond, among the places of all marks.
NEAR = 1500

# Abbreviations, without their last point, by what they do.
#: Followed by a name; never end a unit.
TITLES = frozenset("mr mrs ms dr prof st sr sra srta dra hr fr frau herr mme mlle mgr rev gen col sgt capt lt hon pres gov sen rep dipl ing डॉ प्रो श्री श्रीमती सुश्री कु ดร ผศ รศ г-н г-жа акад проф".split())
#: Followed by a number; end a unit otherwise.
REFS = frozenset("p pp s ss fig figs abb tab tabl sect sec no nos nr núm num cap kap pág pag págs art col vol bd ch chap eq ver v abs ziff rn рис табл стр с гл п пп разд см ص पृ चित्र सं क्र ex ann anm app anh".split())
#: Within a sentence; never end a unit.
INNER = frozenset("cf vgl vs ca approx aprox env e.g i.e z.b d.h u.a o.ä p.ex p.ej c.-à-d bzw resp incl inkl sog evtl ggf см ср т.е напр viz siehe พ.ศ ค.ศ ม.ค ก.พ มี.ค เม.ย พ.ค มิ.ย ก.ค ส.ค ก.ย ต.ค พ.ย ธ.ค น.ส ق.م".split())
#: May also end a sentence; do so unless what follows is lower case.
ENDABLE = frozenset("etc usw al ltd inc co corp jr bros mm cm km kg px ms min max проц год г гг др т.д т.п тыс млн млрд руб u.s a.m p.m u.k ph.d мм см кг uvm إلخ الخ इत्यादि".split())
#: Of these, ones after which a number goes on.
ENDABLE_NUMBER = frozenset("al u.s max min".split())
#: Nouns before a letter that is a name of its own, not an initial.
LABELS = frozenset("plan option version type class part appendix variant group case step table figure section level vitamin item list column row sheet fall klasse typ anhang gruppe plano opción anexo grupo tipo classe annexe groupe вариант план тип группа приложение".split())
MONTHS = frozenset("jan feb mär märz apr april mai jun juni jul juli aug august sep sept september okt oktober nov november dez dezember januar februar".split())

#: Of these, ones that may also begin a sentence, in lower case.
STARTERS = frozenset("approx ca".split())

_ABBREVIATIONS = TITLES | REFS | INNER | ENDABLE | MONTHS
#: Second parts of abbreviations whose parts may be set apart.
_SECOND = frozenset(a.partition(".")[2] for a in INNER | ENDABLE if "." in a)

HARD = frozenset("!?。！？؟।॥｡")
_LETTERS = r"\p{L}\p{M}"
_THAI = "ก-ฺเ-๎"
#: kind -> (openers, closers). A mark may open one kind and close another.
KINDS = {"p": ("(（[［", ")）]］"), "d": ("“", "”"), "g": ("„", "“”"), "a": ("«", "»"), "b": ("»", "«"), "s": ("‘", "’"), "l": ("‚", "‘’"), "c": ("「", "」"), "w": ("『", "』"), "q": ('"', '"')}
MARKS = sorted({m for pair in KINDS.values() for marks in pair for m in marks})
_CLOSERS = frozenset(")）]］”“»«’‘」』\"")
_OPENERS = frozenset("(（[［“„«‘‚「『\"¿¡")
_EVENT = regex.compile(rf"(?P<blank>\n[^\S\n]*\n)|(?P<term>[.!?…。！？؟।॥｡]+)|(?P<mark>[{regex.escape(''.join(MARKS))}])|(?P<thai>(?<=[{_THAI}])[^\S\n]+(?=[{_THAI}]))")
_BLANK = regex.compile(r"\n[^\S\n]*\n")
_CLOSING = regex.compile(rf"[{regex.escape(''.join(sorted({c for _, closers in KINDS.values() for c in closers})))}]")
_NONSPACE = regex.compile(r"\S")
_SCRIPT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_WORD = regex.compile(rf"[\w{_LETTERS}]+\.?")
_VOWELS = regex.compile(r"[aeiouyäöüáéíóúàèâêîôûëïаеёиоуыэюя]", regex.I)


class Kind(IntFlag):
    """Classes of what stands before a point. PARTS: of letters with points between them, together with the letter before if parts are set apart."""

    NONE = auto()  # no word
    NUMBER = auto()
    SMALL = auto()  # of one or two digits
    LISTED = auto()  # at the begin of a list item
    LETTERS = auto()  # a lone letter, or letters with points between them
    SCRIPT = auto()  # of a script whose letters are words
    DOTTED = auto()
    LONG_LAST = auto()  # more than one letter after the last point within
    CAPS = auto()  # the last part is in capitals
    BRIEF = auto()  # its last part is no longer than a letter
    LABELLED = auto()  # the word before makes the letter a name
    PARTS_INNER = auto()
    PARTS_ENDABLE = auto()
    PARTS_DOTTED = auto()
    PARTS_NUMBER = auto()
    DATED = auto()  # a number stands before
    STUCK = auto()  # a digit stands directly before
    TITLE = auto()
    REF = auto()
    INNER = auto()
    ENDABLE = auto()
    ENDABLE_NUMBER = auto()
    MONTH = auto()
    SECOND = auto()  # may be the second part of an abbreviation
    VOWELLESS = auto()  # short and without vowels


class Then(IntFlag):
    """Classes of what follows a mark."""

    END = auto()  # nothing
    GAP = auto()  # after white space
    DIGIT = auto()
    LOWER = auto()
    GOES_ON = auto()  # lower case that begins no sentence
    UPPER = auto()
    ALPHA = auto()
    UNCASED = auto()
    OPENER = auto()
    CLOSER = auto()
    BINDS = auto()  # , ; :
    JOINS = auto()  # what goes on within a word, name or number
    REF_OPENER = auto()  # ( # §
    MONTH = auto()
    CAPITALS = auto()  # its second letter is a capital too


K, N = Kind, Then
# The rules for a single point, in order: classes that must all be there, classes of which none may
# be there, classes of what follows of which one must be there (0: any), whether a sentence ends.
_NO_GAP = [
    (0, 0, N.CLOSER, True),
    (0, 0, N.DIGIT | N.BINDS | N.JOINS | N.LOWER, False),
    *[(k, 0, N.ALPHA, False) for k in (K.BRIEF, K.TITLE, K.REF, K.INNER)],
    (K.CAPS, 0, N.CAPITALS, False),
    (0, 0, 0, True),
]
_WITH_GAP = [
    (0, 0, N.BINDS, False),
    (K.NONE, 0, 0, True),
    (K.NUMBER | K.LISTED, 0, 0, False),
    (K.NUMBER | K.SMALL, 0, N.MONTH, False),
    (K.NUMBER, 0, 0, True),
    (K.LETTERS | K.PARTS_INNER, 0, 0, False),
    (K.LETTERS | K.SCRIPT, 0, 0, True),
    (K.LETTERS | K.PARTS_ENDABLE | K.PARTS_DOTTED, 0, N.GOES_ON, False),
    (K.LETTERS | K.PARTS_ENDABLE | K.PARTS_DOTTED | K.PARTS_NUMBER, 0, N.DIGIT, False),
    (K.LETTERS | K.PARTS_ENDABLE | K.PARTS_DOTTED, 0, 0, True),
    (K.LETTERS | K.DOTTED, 0, N.GOES_ON | N.DIGIT, False),
    (K.LETTERS | K.DOTTED | K.LONG_LAST, 0, 0, True),
    (K.LETTERS | K.DOTTED, 0, 0, False),
    (K.LETTERS | K.LABELLED, 0, 0, True),
    (K.LETTERS | K.PARTS_ENDABLE, 0, N.GOES_ON, False),
    (K.LETTERS | K.PARTS_ENDABLE, 0, 0, True),
    (K.LETTERS, 0, 0, False),
    (K.MONTH | K.DATED, 0, N.GOES_ON | N.DIGIT, False),
    (K.MONTH | K.DATED, 0, 0, True),
    (K.STUCK, K.ENDABLE, 0, True),  # "1st.", "30px."
    (K.TITLE, K.REF, 0, False),
    (K.TITLE, 0, N.ALPHA, False),
    (K.ENDABLE, 0, N.GOES_ON, False),
    (K.ENDABLE | K.ENDABLE_NUMBER, 0, N.DIGIT, False),
    (K.ENDABLE, 0, 0, True),
    (K.INNER, 0, 0, False),
    (K.REF, 0, N.DIGIT | N.REF_OPENER | N.GOES_ON, False),
    (K.REF, 0, 0, True),
    (K.VOWELLESS, 0, N.GOES_ON | N.DIGIT, False),
    (0, 0, 0, True),
]


@cache
def ends_after_point(before: int, then: int) -> bool:
    """The compiled rules: whether a point with these classes around it ends a sentence."""
    if then & N.END:
        return True
    rules = _WITH_GAP if then & N.GAP else _NO_GAP
    return next(ends for all_, none, follow, ends in rules if before & all_ == all_ and not before & none and (not follow or then & follow))


@cache
def ends_after_dots(then: int) -> bool:
    """Whether an ellipsis, or several marks none of which ends a sentence by itself, end one: if a new sentence follows."""
    if then & N.END:
        return True
    if then & N.DIGIT and not then & N.GAP:
        return False
    return bool(then & (N.UPPER | N.OPENER | N.DIGIT | N.UNCASED))


@cache
def abbreviations() -> dict:
    """The trie of abbreviations, spelled backwards: character -> node; '' -> the classes of the word that ends there."""
    root: dict = {}
    lists = [(TITLES, K.TITLE), (REFS, K.REF), (INNER, K.INNER), (ENDABLE, K.ENDABLE), (ENDABLE_NUMBER, K.ENDABLE_NUMBER), (MONTHS, K.MONTH), (_SECOND, K.SECOND)]
    for words, kind in lists:
        for word in words:
            node = root
            for c in reversed(word):
                node = node.setdefault(c, {})
            node[""] = int(node.get("", 0) | kind)
    return root


_LONGEST = max(map(len, _ABBREVIATIONS))


def _kinds(word: str) -> int:
    """The classes of a whole word in the trie."""
    node = abbreviations()
    for c in reversed(word):
        node = node.get(c)
        if node is None:
            return 0
    return node.get("", 0)


class View:
    """A text, or a part of one whose ends are open. ``beyond``: something was asked that only the text beyond an open end can tell."""

    def __init__(self, text: str, open_left: bool = False, open_right: bool = False):
        self.text, self.open_left, self.open_right = text, open_left, open_right
        self.beyond = False
        self.closers = _Closers(text)

    def at_left(self, p: int) -> None:
        self.beyond |= p <= 0 and self.open_left

    def at_right(self, p: int) -> None:
        self.beyond |= p >= len(self.text) and self.open_right

    def next(self, j: int) -> int:
        """The place of the next character that is no white space, or -1."""
        m = _NONSPACE.search(self.text, j)
        if m is None:
            self.at_right(len(self.text))
            return -1
        return m.start()

    def spaces_before(self, p: int) -> int:
        """Where the white space that ends at p begins."""
        while p and self.text[p - 1].isspace():
            p -= 1
        self.at_left(p)
        return p


def _is_letter(c: str) -> bool:
    return c.isalpha() or (c > "\x7f" and unicodedata.category(c)[0] == "M")


def _cased(c: str) -> bool:
    return c.islower() or c.isupper() or c.istitle()


def _follows(view: View, j: int) -> int:
    """The classes of what follows the marks that end at j."""
    text, k = view.text, view.next(j)
    if k < 0:
        return N.END
    n, out = text[k], N.GAP if k > j else 0
    if n.isdigit():
        out |= N.DIGIT
    if n in ",;:":
        out |= N.BINDS
    if n in "-–—/|_@%":
        out |= N.JOINS
    if n in ")]":
        out |= N.CLOSER
    if n in _OPENERS:
        out |= N.OPENER
    if n in "(#§":
        out |= N.REF_OPENER
    if n.isalpha():
        out |= N.ALPHA if _cased(n) else N.ALPHA | N.UNCASED
        if n.isupper() and text[k + 1 : k + 2].isupper():
            out |= N.CAPITALS
        view.at_right(k + 1)
    if n.isupper() or n.istitle():
        out |= N.UPPER
    follow = _WORD.match(text, k)
    if follow:
        view.at_right(follow.end())
        word = follow[0].casefold()
        if n.islower():
            out |= N.LOWER if "_" in word or (word[-1] == "." and word[:-1] in STARTERS) else N.LOWER | N.GOES_ON
        if word.rstrip(".") in MONTHS:
            out |= N.MONTH
    elif n.islower():
        out |= N.LOWER | N.GOES_ON
    return int(out)


def _number_before(view: View, i: int) -> int:
    """The classes of the number that ends at i."""
    text, p = view.text, i
    while p and i - p < 4 and text[p - 1].isdecimal():
        p -= 1
    view.at_left(p)
    digits = i - p
    out = K.NUMBER
    joined = p and text[p - 1] in ".,:/-"
    if digits <= 2 and not joined:
        out |= K.SMALL
    if digits <= 3:
        q = p - 1 if p and text[p - 1] == "(" else p
        r = view.spaces_before(q)
        gap = text[r:q]
        if r == 0 or _BLANK.search(gap) or ("\n" in gap and text[r - 1] in '.!?…。！？؟।:"”»'):
            out |= K.LISTED
    return int(out)


def _word_before(view: View, p: int) -> tuple[str, bool]:
    """The word or number before p, with at most one line break between, and whether it has a point; '' if there is none."""
    text, q = view.text, view.spaces_before(p)
    if text.count("\n", q, p) > 1:
        return "", False
    point = bool(q) and text[q - 1] == "."
    end = q - point
    r = end
    while r and (text[r - 1].isdecimal() or _is_letter(text[r - 1])):
        r -= 1
    view.at_left(r)
    return text[r:end], point


def _before(view: View, i: int) -> int:
    """The classes of what stands before a point at i."""
    text = view.text
    if not i or not (text[i - 1].isdecimal() or _is_letter(text[i - 1])):
        view.at_left(i)
        return int(K.NONE | K.BRIEF)
    if text[i - 1].isdecimal():
        return _number_before(view, i)
    p, last = i, -1
    while p:
        c = text[p - 1]
        if not _is_letter(c):
            if c not in ".-" or p < 2 or p == i or not _is_letter(text[p - 2]) or not _is_letter(text[p]):
                break
            if c == "." and last < 0:
                last = p
            if last >= 0 and i - p > _LONGEST:  # no abbreviation is as long, and nothing else counts here
                break
        p -= 1
    view.at_left(p - 1 if p < 2 else p)
    token = text[p:i]
    word = token.casefold()
    tail = text[last:i] if last >= 0 else token
    kinds = _kinds(word)
    out = kinds
    if last >= 0:
        out |= K.DOTTED
    out |= K.LONG_LAST if len(tail) > 1 else K.BRIEF
    if tail.isupper():
        out |= K.CAPS
    lone = len(tail) == 1
    before, point = _word_before(view, p) if lone or kinds & (K.SECOND | K.MONTH) else ("", False)
    parts = f"{before.casefold()}.{word}" if point and len(before) == 1 and last < 0 else word  # parts set apart: "z. B."
    held = _kinds(parts)
    if lone or last >= 0 or (parts != word and held & (K.INNER | K.ENDABLE)):
        out |= K.LETTERS
        if lone and not _cased(tail) and _SCRIPT.match(tail):
            out |= K.SCRIPT
        out |= (K.PARTS_INNER if held & K.INNER else 0) | (K.PARTS_ENDABLE if held & K.ENDABLE else 0) | (K.PARTS_NUMBER if held & K.ENDABLE_NUMBER else 0) | (K.PARTS_DOTTED if "." in parts else 0)
        if before and not point and before.casefold() in LABELS:
            out |= K.LABELLED
    if before.isdigit():
        out |= K.DATED
    if p and text[p - 1].isdecimal():
        out |= K.STUCK
    if len(word) <= 4 and _cased(word[0]) and not _VOWELS.search(word):
        out |= K.VOWELLESS
    return int(out)


def ends(view: View, i: int, j: int) -> bool:
    """Whether the symbol of the marks at i to j, outside of any bracket or quote, ends a sentence."""
    text = view.text
    marks = text[i:j]
    if not HARD.isdisjoint(marks):
        return True
    if "…" in marks or len(marks) > 1:
        return ends_after_dots(_follows(view, j))
    if text[j : j + 1] == " " and text[j + 1 : j + 2].isupper() and i and text[i - 1].islower():  # the plain case, without classes: a word, a space, a capital
        p = i - 1
        while p and text[p - 1].islower():
            p -= 1
        if i - p > 2 and p and text[p - 1].isspace() and not _kinds(text[p:i].casefold()) & ~K.SECOND:
            return True
    return ends_after_point(_before(view, i), _follows(view, j))


def _apostrophe(text: str, i: int) -> bool:
    return text[i] in "‘’" and 0 < i < len(text) - 1 and text[i - 1].isalpha() and text[i + 1].isalpha()


class _Closers:
    """Which brackets and quotes of a text are closed before the next blank line. ``undecided``: the text ended before that was known of one."""

    def __init__(self, text: str):
        self.text, self.undecided = text, False
        self.places: dict[str, list[int]] | None = None
        self.blanks: list[int] = []

    def closed(self, j: int, closers: str) -> bool:
        text = self.text
        found = [e for e in (text.find(c, j, j + NEAR) for c in closers) if e >= 0]
        e = min(found, default=-1)
        if e >= 0 and not _apostrophe(text, e):
            return text.find("\n", j, e) < 0 or not _BLANK.search(text, j, e)
        if self.places is None:
            self.places = {}
            for m in _CLOSING.finditer(text):
                if not _apostrophe(text, m.start()):
                    self.places.setdefault(m[0], []).append(m.start())
            self.blanks = [m.start() for m in _BLANK.finditer(text)]
        ends = [p[k] for p in (self.places.get(c, []) for c in closers) if (k := bisect_left(p, j)) < len(p)]
        k = bisect_left(self.blanks, j)
        blank = self.blanks[k] if k < len(self.blanks) else -1
        self.undecided |= not ends and blank < 0
        return bool(ends) and (blank < 0 or min(ends) < blank)


def _symbol(view: View, m: regex.Match) -> int:
    """The symbol of an event: -1 for marks that end nothing."""
    text = view.text
    i, j = m.span()
    kind = m.lastgroup
    view.at_right(j)
    if kind == "blank":
        return _index()["blank"]
    if kind == "thai":
        return _index()["end"]
    if kind == "term":
        return _index()["end"] if ends(view, i, j) else -1
    mark = text[i]
    if _apostrophe(text, i):
        return -1
    opens = 0
    for o, c in KINDS.values():
        if mark in o:
            opens |= view.closers.closed(j, c)
    back = view.spaces_before(i) - 1
    adjacent = back < 0 or text[back] in _CLOSERS or text[back] in HARD or text[back] in ".…" or "\n\n" in text[back:i] or (i - back > 1 and "ก" <= text[back] <= "๎")
    after = 0
    if back >= 0 and (text[back] in HARD or text[back] in ".…"):
        k = view.next(j)
        if k < 0 or text[k] in _OPENERS and text[k] not in "(（[［":
            after = 1
        elif text[k].isupper() or text[k].istitle() or text[k].isdigit():
            after = 2
    return _index()[(mark, opens, int(adjacent), after)]


@cache
def _index() -> dict:
    keys = ["blank", "end"] + [(m, o, a, e) for m in MARKS for o in (0, 1) for a in (0, 1) for e in (0, 1, 2)]
    return {k: i for i, k in enumerate(keys)}


@cache
def transducer() -> tuple[np.ndarray, np.ndarray, list[list[int]], list[list[bool]], list[list[bool]]]:
    """(next state, boundary?) by state and symbol, as arrays and lists, and whether a third level is opened. State 0: nothing open, a unit has just begun.

    States are (open kinds, at most two deep; whether the outermost opened its unit;
    whether a unit has just begun), found from the first state by its symbols.
    """
    first = ((), False, True)
    states, todo, rows, deep = {first: 0}, [first], [], []
    while todo:
        state = todo.pop(0)
        row = []
        for key in _index():
            to, out = _step(state, key)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append((states[to], out))
        rows.append(row)
        deep.append([len(state[0]) == 2 and len(key) == 4 and bool(key[1]) and not any(key[0] in KINDS[k][1] for k in state[0]) for key in _index()])
    nxt = np.array([[t for t, _ in r] for r in rows], dtype=np.int32)
    out = np.array([[o for _, o in r] for r in rows], dtype=bool)
    return nxt, out, nxt.tolist(), out.tolist(), deep


def _step(state, key):
    stack, led, just = state
    if key == "blank":
        return ((), False, True), True
    if key == "end":
        return (((), False, True), True) if not stack else ((stack, led, False), False)
    mark, opens, adjacent, after = key
    for depth in range(len(stack) - 1, -1, -1):
        if mark in KINDS[stack[depth]][1]:
            closed, rest = stack[depth], stack[:depth]
            if rest:
                return (rest, led, False), False
            ends = after == 1 or (after == 2 and not (led and closed != "p"))
            return ((), False, ends), ends
    kind = next((k for k, (o, _) in KINDS.items() if mark in o), None)
    if opens and kind and len(stack) < 2:
        return ((*stack, kind), (just and bool(adjacent)) if not stack else led, False), False
    return (stack, led, False), False


def lex(view: View, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(start, end, symbol) of the events that start in text[start:end]."""
    text = view.text
    end = len(text) if end is None else end
    if view.open_right and len(text.rstrip()) < end:
        view.beyond = True  # white space that may be an event goes on beyond
    for m in _EVENT.finditer(text):
        if m.start() >= end:
            return
        if m.start() >= start:
            s = _symbol(view, m)
            if s >= 0:
                yield m.start(), m.end(), s


def part_boundaries(view: View, state: int, start: int, end: int) -> tuple[list[int], bool]:
    """Places after which a unit ends, for the events that start in text[start:end], begun in ``state``; and whether the states or the view don't suffice to tell."""
    _, _, nxt, out, deep = transducer()
    found, beyond = [], False
    for _, j, s in lex(view, start, end):
        if out[state][s]:
            found.append(j)
        beyond |= deep[state][s]
        state = nxt[state][s]
    return found, beyond or view.beyond or (view.closers.undecided and view.open_right)


def whole_boundaries(text: str) -> list[int]:
    """Places of a whole text after which a unit ends, at any depth."""
    found, beyond = part_boundaries(View(text), 0, 0, len(text))
    return nested_boundaries(text) if beyond else found


def nested_boundaries(text: str) -> list[int]:
    """As ``whole_boundaries``, by rules as in ``_step``, with any depth: the depths at which each kind is open are counted."""
    keys = list(_index())
    stack: list[str] = []
    depths: dict[str, list[int]] = {k: [] for k in KINDS}
    led, just, found = False, True, []
    for _, j, s in lex(View(text)):
        key = keys[s]
        if key == "blank" or (key == "end" and not stack):
            stack, depths, led, just = [], {k: [] for k in KINDS}, False, True
            found.append(j)
            continue
        if key == "end":
            just = False
            continue
        mark, opens, adjacent, after = key
        depth = max((d[-1] for k, d in depths.items() if d and mark in KINDS[k][1]), default=-1)
        kind = next((k for k, (o, _) in KINDS.items() if mark in o), None)
        ends = False
        if depth >= 0:
            closed = stack[depth]
            while len(stack) > depth:
                depths[stack.pop()].pop()
            if not stack:
                ends = after == 1 or (after == 2 and not (led and closed != "p"))
                led = False
        elif opens and kind:
            if not stack:
                led = just and bool(adjacent)
            depths[kind].append(len(stack))
            stack.append(kind)
        just = ends
        if ends:
            found.append(j)
    return found


def chunk_function(text: str, start: int, end: int) -> list[int]:
    """The state after the chunk, for each state before it."""
    nxt = transducer()[0]
    at = np.arange(len(nxt), dtype=np.int32)
    for _, _, s in lex(View(text), start, end):
        at = nxt[at, s]
    return at.tolist()


def units(text: str, ends: list[int]) -> list[tuple[int, int]]:
    """The units between boundaries, from first to last character that is no white space."""
    out, last = [], 0
    for e in [*ends, len(text)]:
        piece = text[last:e]
        bare = piece.strip()
        if bare:
            lead = len(piece) - len(piece.lstrip())
            out.append((last + lead, last + lead + len(bare)))
        last = e
    return out


def split_text(text: str) -> list[tuple[int, int]]:
    return units(text, whole_boundaries(text))


def _emit(batch: pa.RecordBatch, found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    at = np.repeat(np.arange(len(found)), [len(f) for f in found])
    flat = [u for f in found for u in f]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([a for a, _ in flat], pa.int64()), pa.array([b for _, b in flat], pa.int64())], names=["doc_id", "start_char", "end_char"])


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char): the sentence units of every document, offsets in code points, each once.

    Null, empty and blank texts have no units. Documents of up to CHUNK characters are
    run through the transducer at once; longer ones chunk by chunk, see the module's text.
    A chunk is read with LEFT characters before and RIGHT after it; texts in which an event
    cannot be told from that, or with brackets or quotes more than two deep, are run whole.
    """
    docs = pick(documents, "doc_id", "text").where("text is not null")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _emit(batch, [split_text(t) for t in batch.column(1).to_pylist()])

    quick = spread(docs.where(F.length("text") <= CHUNK)).mapInArrow(short, schema)
    return quick.unionByName(_long_units(docs.where(F.length("text") > CHUNK), schema)).distinct()


def _long_units(docs: DataFrame, schema: T.StructType) -> DataFrame:
    keyed = docs.withColumn("h", F.xxhash64("text"))
    size, left, right = CHUNK, LEFT, RIGHT

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                ks = range(-(-len(text) // size))
                firsts = [max(k * size - left, 0) for k in ks]
                at = pa.array([i] * len(ks), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(ks, pa.int32()), pa.array(firsts, pa.int32()), pa.array([text[f : (k + 1) * size + right] for k, f in zip(ks, firsts)], pa.string())], names=["doc_id", "h", "k", "first", "piece"])

    kind = schema["doc_id"].dataType
    key = [T.StructField("doc_id", kind), T.StructField("h", T.LongType()), T.StructField("k", T.IntegerType())]
    chunks = cut(keyed.dropDuplicates(["doc_id", "h"]).mapInArrow(pieces, T.StructType([*key, T.StructField("first", T.IntegerType()), T.StructField("piece", T.StringType())])))

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [chunk_function(p, k * CHUNK - f, (k + 1) * CHUNK - f) for k, f, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "h", "k", "f"])

    scanned = cut(chunks.mapInArrow(functions, T.StructType([*key, T.StructField("f", T.ArrayType(T.IntegerType()))])))
    # Prefix scan by doubling: after the step of distance d, f spans up to 2 d chunks.
    order = Window.partitionBy("doc_id", "h").orderBy("k")
    most = scanned.agg(F.max("k")).first()[0] or 0
    d = 1
    while d <= most:
        scanned = scanned.withColumn("g", F.lag("f", d).over(order)).withColumn("f", F.when(F.col("g").isNull(), F.col("f")).otherwise(F.transform("g", lambda s: F.col("f")[s]))).drop("g")
        d *= 2
    begins = scanned.select("doc_id", "h", "k", F.coalesce(F.lag(F.col("f")[0]).over(order), F.lit(0)).alias("state"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, beyond = [], []
            for k, f, p, s in zip(*(b.column(c).to_pylist() for c in range(2, 6))):
                found, more = part_boundaries(View(p, f > 0, len(p) == (k + 1) * CHUNK - f + RIGHT), s, k * CHUNK - f, (k + 1) * CHUNK - f)
                made.append([f + e for e in found])
                beyond.append(more)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int64())), pa.array(beyond, pa.bool_())], names=["doc_id", "h", "ends", "beyond"])

    whole = chunks.join(begins.withColumnRenamed("doc_id", "__d"), (F.col("doc_id").eqNullSafe(F.col("__d"))) & (chunks["h"] == begins["h"]) & (chunks["k"] == begins["k"])).select("doc_id", chunks["h"], chunks["k"], "first", "piece", "state")
    found = whole.mapInArrow(emit, T.StructType([*key[:2], T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("beyond", T.BooleanType())]))
    ends = found.groupBy("doc_id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ends")))).alias("ends"), F.max("beyond").alias("beyond"))
    texts = keyed.join(ends.withColumnRenamed("doc_id", "__d"), F.col("doc_id").eqNullSafe(F.col("__d")) & (keyed["h"] == ends["h"])).select("doc_id", "text", "ends", "beyond")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _emit(b, [units(t, whole_boundaries(t) if beyond else e) for t, e, beyond in zip(*(b.column(c).to_pylist() for c in range(1, 4)))])

    return texts.mapInArrow(close, schema)
