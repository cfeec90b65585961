"""Sentences of texts in any language and script.

Every code point has its class of the standard sentence-break property (terminators of all scripts,
closing marks, letters by case, figures, what continues a sentence), from a table made by rule. A
terminator is a candidate; the standard rules on the classes around it decide, with these tailorings:
a line break always ends a sentence; nothing is cut inside a quotation or a bracket, and a sentence
goes on after a quotation that it continues; a point doesn't end a sentence after an abbreviation of
the text's language, unless it is one that may stand at the end and the next word begins a
sentence; and Thai, which has no terminators, is cut at blanks that aren't beside a figure.

The language of a word is its script's, or for Latin letters the one that the row tells, else the one
whose function words the text has most of.

All work is per text and linear in its length: one pass for quotations and one over terminators.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encode import _in_parts

#: The sentence-break classes, each with the letter that stands for it in a string of classes.
CLASSES = {"Sep": "p", "CR": "p", "LF": "p", "Sp": " ", "Lower": "l", "Upper": "u", "OLetter": "o", "Numeric": "n", "ATerm": "a", "STerm": "s", "SContinue": "k", "Close": "c", "Extend": "e", "Format": "f"}


class _Classes(dict):
    """The letter of every code point's class, "x" for none; found by rule when a code point is first met."""

    _RULE = regex.compile("|".join(rf"(?P<{name}>\p{{SB={name}}})" for name in CLASSES))

    def __missing__(self, point: int) -> str:
        m = self._RULE.match(chr(point))
        found = CLASSES[m.lastgroup] if m else "x"
        if found in "ul" and not chr(point).isalpha():
            found = "x"  # a numeral or sign in the form of a letter doesn't tell how a sentence goes on
        self[point] = found
        return found


_CLASS_OF = _Classes()


@lru_cache(maxsize=1)
def _points() -> tuple[frozenset[str], frozenset[str]]:
    """Terminators that end a sentence whatever follows, and those of East Asian width, which need no blank after them."""
    every = "".join(map(chr, range(0x110000)))
    strong, points = (set(regex.findall(rf"\p{{SB={name}}}", every)) for name in ("STerm", "ATerm"))
    dense = {c for c in strong | points if unicodedata.east_asian_width(c) in "WFH"}
    return frozenset(strong - dense), frozenset(dense)


@lru_cache(maxsize=1)
def _terminators() -> tuple[re.Pattern, re.Pattern]:
    """Runs of terminators, with the ellipsis and the Greek question mark, which looks like a semicolon."""
    every = ".\u2024" + "".join(sorted(frozenset().union(*_points())))
    low, high = ("".join(c for c in every if (c >= chr(0x10000)) == far) for far in (False, True))
    # Most lines have no character beyond U+FFFF, for which a set is tested one by one.
    return re.compile(rf"[…;\u037e{re.escape(low)}]+(?:\s*[!?](?![\w]))*"), re.compile(rf"[…;\u037e{re.escape(low + high)}]+(?:\s*[!?](?![\w]))*")


_BEYOND = re.compile("[\U00010000-\U0010FFFF]")
_LINE = re.compile("[^\n\r\x0b\x0c\x85\u2028\u2029]+")
_CLOSERS = "\"'”’»«“)]}」』》】）〉〕›‹*_~"
_OPENERS = "\"'“„«»‘‚‹(¿¡[{「『《〈【（—–-‐*_"
# What closes what; German and other quotations turn the marks round.
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "〔": "〕", "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’", "‚": "‘’", '"': '"', "『": "』"}
_BRACKETS = "([{（【〔"
_TITLES = "《〈"
_MARKS = re.compile("|".join(map(re.escape, dict.fromkeys("".join(_PAIRS) + "".join(_PAIRS.values())))))
#: Marks at the head of a line: bullets, times, numbering, a speaker's name.
_HEAD = re.compile(r"\s*(?:(?:[-*•–—▪·●◦>»]|\d{1,3}[.)]|[a-zA-Z]\))+\s+)?(?:[\[(<@]?\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d+)?[\])>]?\s+(?:[-–—]\s+)?)?(?:>>\s*)?(?:(?:[^\W\d_]\.|[^\W\d_][\w'’-]*)(?: (?:[^\W\d_]\.|[^\W\d_][\w'’-]*)){0,2}(?: \d+)?\s?[:：]\s+)?")
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)+", re.U)

# Abbreviations by language. "before" stand before what they belong to, so that their point ends no
# sentence; "figure" do so only before a figure; "last" may end a sentence, and do before a capital, a figure or a host.
_ABBREVIATIONS = {
    "en": {
        "before": "mr mrs ms dr prof st mt rev gen capt col lt sgt hon messrs cf vs feat e.g i.e viz al eds ca",
        "figure": "fig figs ep eps ch chap vol vols pp p sect sec§ no nos art par ex cap ed jan feb mar apr jun jul aug sep sept oct nov dec rs min sec",
        "last": "etc inc ltd co corp jr p.m a.m u.s u.k min sec hr hrs approx",
    },
    "de": {
        "before": "hr fr frl dr prof st abb vgl sog inkl exkl zzgl evtl ggf bzw mio mrd tsd ca z.b d.h u.a i.d.r s.o s.u dipl ing jh hl geb vs cf",
        "figure": "bd bde nr kap ep vol art fig s jan feb mär apr jun jul aug sep sept okt nov dez min sec",
        "last": "usw usf etc dgl min sec std u.s u.k co",
    },
    "es": {
        "before": "sr sra sres srta dra dres dr prof don ud uds vd tel tfno av avda p.ej ee depto cf vs gral",
        "figure": "núm num pág págs cap caps art fig vol ep no nos ene feb mar abr jun jul ago sep sept oct nov dic min sec",
        "last": "etc aprox uu ee.uu p.m a.m min sec u.s u.k co",
    },
    "fr": {
        "before": "mgr mme mlle mm me dr prof st boul bd tél p.ex c.-à-d ex éd av cf vs mr",
        "figure": "chap n° no nos vol fig art ep p pp janv févr avr juil sept oct nov déc min sec",
        "last": "etc env svp min sec u.s u.k",
    },
    "ru": {"before": "см рис проф ок напр т.е тыс млн млрд им ул пр акад доц гр", "figure": "стр табл гл", "last": "т.д т.п др руб коп г ч мин сек кг"},
    "el": {"before": "κ κα κος κ.κ π.χ επ αρ δρ καθ βλ", "figure": "σελ", "last": "κ.λπ κ.ά"},
    "hi": {"before": "डॉ प्रो श्री सु पं", "figure": "", "last": ""},
    "ar": {"before": "د أ م ص ج", "figure": "", "last": ""},
}
# Abbreviations of amounts, which may end a sentence only after a figure and its unit.
_COUNTED = {"approx", "aprox", "env", "ca"}
# German words after which a figure with a point is an ordinal number.
_BEFORE_ORDINAL = set("am im dem den der des die das zum zur vom beim bis ab seit jeder jede jeden jedes jeweils unser unsere ihr ihre sein seine mein meine ein eine einem einer".split())
# Codes and names of the languages written in Latin letters that have abbreviations here.
_CODES = {"en": "en", "eng": "en", "english": "en", "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "es": "es", "spa": "es", "spanish": "es", "español": "es", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr"}
# Codes of languages in other scripts, whose words tell their language themselves.
_OTHER_SCRIPTS = set("ru rus el ell gre hi hin ar ara zh zho chi cmn ja jpn jp th tha ko kor he heb uk ukr bg bul sr srp fa fas ur urd bn ben ta tam te tel ka kat hy hye am amh km khm lo lao my mya".split())
# Function words that tell the language.
_FUNCTION_WORDS = {
    "en": "the and of to is was it that he she we i you they this had have with for are not his her my be at from by but were a an in on gave then left",
    "de": "der die das und ist nicht ich wir sie es ein eine mit auf den dem zu von war hat sich auch für im am wie noch haben sind",
    "es": "el la los las y es que de en un una no se por con para su lo como más pero fue este esta del al nos muy",
    "fr": "le la les et est que de en un une ne pas pour dans ce il elle nous vous je du des au sur avec qui plus mais c d l était",
}
_TELLING = {w: [g for g in _FUNCTION_WORDS if w in _FUNCTION_WORDS[g].split()] for words in _FUNCTION_WORDS.values() for w in words.split()}


class _Table(NamedTuple):
    before: frozenset[str]
    figure: frozenset[str]
    last: frozenset[str]
    every: frozenset[str]
    longest: int
    #: whether its own rules hold: English and German or an unknown language
    english: bool
    german: bool


@lru_cache(maxsize=16)
def _table(language: str | None) -> _Table:
    """The abbreviations of a language written in Latin letters (of all of them if it is None) and of the other scripts' languages."""
    latin = set(_CODES.values())
    chosen = [g for g in _ABBREVIATIONS if g not in latin or language in (g, None)]
    before, figure, last = (frozenset(w for g in chosen for w in _ABBREVIATIONS[g][kind].split()) for kind in ("before", "figure", "last"))
    every = before | figure | last | _COUNTED
    return _Table(before, figure, last, every, max(map(len, every)), language in ("en", None), language in ("de", None))


_LATIN = re.compile(r"[^\W\d_]+")


def language_of(text: str, told: str | None = None) -> str | None:
    """The Latin-script language whose abbreviations hold: the one told, by code or name, else by the text's function words; None if open."""
    code = re.match(r"[^\W\d_]*", (told or "").strip().casefold())[0]
    if code in _CODES:
        return _CODES[code]
    if code in _OTHER_SCRIPTS:
        return None
    votes = dict.fromkeys(_FUNCTION_WORDS, 0.0)
    for m in _LATIN.finditer(text.casefold()):
        for g in _TELLING.get(m[0], ()):
            votes[g] += 1 / len(_TELLING[m[0]])
    best = max(votes, key=votes.get)
    return best if votes[best] > max(v for g, v in votes.items() if g != best) else None


def _spans(line: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of a line as (opening, after closing). Marks without a partner count for nothing."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    waiting: dict[str, int] = {}
    n = len(line)
    for m in _MARKS.finditer(line):
        ch, i = m[0], m.start()
        if ch in "’'" and 0 < i < n - 1 and line[i - 1].isalnum() and line[i + 1].isalnum():
            continue  # an apostrophe
        if waiting.get(ch):
            k = len(stack) - 1
            while ch not in _PAIRS[stack[k][0]]:
                k -= 1
            for opening, _ in stack[k:]:
                for c in _PAIRS[opening]:
                    waiting[c] -= 1
            found.append((stack[k][1], i + 1))
            del stack[k:]
        elif ch in _PAIRS:
            if ch in "‘“" and i and line[i - 1].isalnum() and ch == "‘":
                continue
            if ch == "(" and i and line[i - 1] in ":;=-":
                continue  # a face
            if ch in "»›" and (i + 1 == n or line[i + 1].isspace()):
                continue
            stack.append((ch, i))
            for c in _PAIRS[ch]:
                waiting[c] = waiting.get(c, 0) + 1
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a >= outer[-1][1]:
            outer.append((a, b))
    return outer


_DELIMITERS = frozenset("([“\"«‘„»—–,;:")
_NUMBER_END = re.compile(r"\d[\w.,]*$")
_ROMAN = re.compile(r"[IVXLCDM]{2,}(?![^\W_])")
_WORDS = re.compile("[ulon]")
_SPACE = re.compile(r"\s*")


class _Line:
    """A line with its classes, and what has been found out about it so far."""

    __slots__ = ("chains", "letter", "line", "known", "kinds", "seen", "table")

    def __init__(self, line: str, table: _Table) -> None:
        self.line, self.kinds, self.table = line, line.translate(_CLASS_OF), table
        self.known = self.letter = -1
        self.seen = 0
        self.chains: dict[int, int] = {}

    def next_word(self, at: int) -> int:
        """The first letter or figure at or after ``at``, the line's length if there is none; ``at`` must not go back."""
        if self.known < at:
            m = _WORDS.search(self.kinds, at)
            self.known = m.start() if m else len(self.line)
        return self.known

    def last_letter(self, before: int) -> int:
        """The last letter before a place, which must not go back; -1 if there is none."""
        for i in range(before - 1, self.seen - 1, -1):
            if self.line[i].isalpha():
                self.letter = i
                break
        self.seen = before
        return self.letter

    def look(self, at: int) -> str:
        """How the line goes on at ``at``: 'lower', 'upper', 'digit', 'other' by its next letter or figure, or 'host' for a host's name."""
        j = self.next_word(at)
        if j == len(self.line):
            return "other"
        kind = self.kinds[j]
        if kind == "n":
            return "digit"
        if kind == "u":
            return "upper"
        if kind == "l":
            m = _HOST.match(self.line, j)
            if m and "." in m[0] and all(c in _OPENERS for c in self.line[at:j]):
                name, _, last = m[0].rpartition(".")
                if len(last) > 1 and last.isalpha() and last.islower() and m[0].count(".") <= 3 and len(name.partition(".")[0]) > 2:
                    return "host"
            return "lower"
        return "other"

    def chain(self, begin: int, dot: int) -> int:
        """Where a chain of one or two letters with points ("p. m") that ends before ``dot`` begins; -1 if there is none."""
        line, path = self.line, []
        while (found := self.chains.get(dot)) is None:
            a = dot
            while a > begin and dot - a < 3 and line[a - 1].isalpha():
                a -= 1
            # What holds if no chain goes before it.
            alone = a if a == begin or line[a - 1].isspace() or line[a - 1] in _DELIMITERS else -1
            path.append((dot, alone))
            if not 1 <= dot - a <= 2:
                path[-1] = (dot, found := -1)
                break
            before = a - 1 if a > begin and not line[a - 1].isspace() else a - 2
            if before < begin or line[before] != ".":
                found = alone
                break
            dot = before
        for dot, alone in reversed(path):
            found = self.chains[dot] = alone if found == -1 else found
        return found

    def abbreviated(self, begin: int, dot: int) -> str | None:
        """How the point at ``dot`` reads after the word before it: 'never' ends a sentence, 'maybe', 'figure' (not before one), both or None."""
        line, table = self.line, self.table
        a = line.rfind(" ", begin, dot) + 1 or begin
        word = line[a:dot]
        if len(word) > 2 and word.isalpha() and word.casefold() not in table.every:
            return None
        # Longer words are no abbreviations.
        a = dot
        while a > begin and dot - a <= table.longest and not line[a - 1].isspace() and line[a - 1] not in _DELIMITERS:
            a -= 1
        if a == dot:
            return None
        start = self.chain(begin, dot)
        if start >= 0 and dot - start > 2:
            parts = "".join(line[start:dot].split()).casefold() if dot - start <= 2 * table.longest else ""
            return "maybe" if parts in table.last else "never"
        if dot - a > table.longest:
            return None
        own = line[a:dot]
        word = own.casefold().lstrip("'’.")
        before = a
        while before > begin and line[before - 1].isspace():
            before -= 1
        last = line[before - 1] if before > begin else ""
        if word in _COUNTED:
            b = max(line.rfind(" ", begin, before), begin - 1) + 1
            if _NUMBER_END.search(line, b, before):
                return "maybe"
            c = b
            while c > begin and line[c - 1].isspace():
                c -= 1
            d = max(line.rfind(" ", begin, c), begin - 1) + 1
            return "maybe" if c > begin and _NUMBER_END.search(line, d, c) else "never"
        if word in table.last and not (len(word) == 1 and word.isalpha() and not last.isdigit()):
            return "figure maybe" if word in table.figure else "maybe"
        if word in table.before:
            return "never"
        if word in table.figure and not (len(own) == 1 and own.isalpha()):
            return "figure"
        if len(own) == 1 and own.isalpha():
            if own.isupper():
                return None if own == "I" and table.english and last.islower() else "never"
            return "maybe" if last.isdigit() else "never"
        return None

    def ordinal(self, begin: int, dot: int) -> bool:
        """Whether a German figure before the point at ``dot`` is an ordinal number by the word before it."""
        line = self.line
        a = dot
        while a > begin and dot - a < 3 and line[a - 1].isdigit():
            a -= 1
        if not 1 <= dot - a <= 2 or a == begin or not line[a - 1].isspace():
            return False
        while a > begin and line[a - 1].isspace():
            a -= 1
        b = max(line.rfind(" ", begin, a), begin - 1) + 1
        return line[b:a].casefold() in _BEFORE_ORDINAL

    def runs_on(self, begin: int, term: int, end: int) -> bool:
        """Whether a new sentence begins at ``end`` though no blank is there ("an idea.No doubt")."""
        line = self.line
        at = end
        while at < len(line) and line[at] in _OPENERS:
            at += 1
        if at >= len(line) or term == begin:
            return False
        before, after, next_after = line[term - 1], line[at], line[at + 1 : at + 2]
        point = line[term:end] == "."
        how = self.abbreviated(begin, term) if point else None
        if how in ("never", "figure maybe") or (how == "figure" and after.isdigit()):
            return False
        # At most three letters matter.
        a = term
        while a > begin and term - a < 3 and line[a - 1].isalnum():
            a -= 1
        letters = term - a
        if not (before.isdigit() or before in _CLOSERS or before == "." or letters > 1 or not point):
            return False
        if after.isupper() and not before.isupper() and next_after != ".":
            return True
        if at > end:
            return line[end] in "([“„«¿¡—" and not before.isspace() and (after.isalnum() or after in "¿¡")
        if line[term:end].startswith("..") or line[term] == "…":
            return False
        if after.isdigit():
            return before.isalpha() and how is None and letters > 2
        return after.isalpha() and not after.islower() and not after.isupper() and before.isalpha() and not before.islower()

    def ends(self, begin: int, term: int, end: int, quoted: tuple[int, int] | None) -> bool:
        """Whether a sentence that began at ``begin`` ends at ``end``; the terminator begins at ``term``.

        ``quoted`` is the quotation or bracket that closes there, if the terminator is inside one.
        """
        line, kinds = self.line, self.kinds
        at = _SPACE.match(line, end).end()
        if at == len(line):
            return True
        spaced = at > end
        kind, run = line[term], line[term:end]
        if run == "." and quoted is None:
            return self.point(begin, term, at) if spaced else self.runs_on(begin, term, end)
        strong_marks, dense_marks = _points()
        first_char = line[at]
        look = self.look(at)
        dash = first_char in "—–-"
        strong = kind in strong_marks or "!" in run or "?" in run
        dense = kind in dense_marks or (len(run) > 1 and any(c in dense_marks for c in run))
        ellipsis = (kind == "…" or run.startswith("..")) and not dense
        if quoted is not None:
            opening = line[quoted[0]]
            a, b = begin, quoted[0]
            while a < b and (line[a] in " \t" or line[a] in _OPENERS):
                a += 1
            first = a == b
            while b > begin and line[b - 1].isspace():
                b -= 1
            colon = b > begin and line[b - 1] in ":：,，"
            if look == "lower" or (dash and look == "other"):
                return False
            if (kinds[at] == "k" and not dash) or first_char in ";；؛·":
                return False
            if opening in _TITLES:
                return False
            if look in ("upper", "digit", "host"):
                return first or opening not in _BRACKETS
            if first_char in _PAIRS and first_char not in _TITLES and first is False:
                return True
            # Scripts without capitals: what follows a quotation at a sentence's head tells who said it.
            if opening in _BRACKETS:
                return first
            if colon:
                return True
            return not first and spaced or (first and first_char in _PAIRS and first_char not in _BRACKETS)
        if dense:
            return not (dash and look == "lower")
        if not spaced:
            if strong:
                return (look == "other" and first_char not in ",;:)" and ord(first_char) > 0x2E7F) or (kind in strong_marks and kind > "\u00ff" and kind not in "‼‽⁇⁈⁉") or self.runs_on(begin, term, end)
            return (kinds[term] == "a" or kind == "…") and self.runs_on(begin, term, end)
        # A sentence goes on before a mark that continues it.
        if kinds[at] == "k" and not dash:
            return False
        if ellipsis:
            return look in ("upper", "digit", "host") or (look == "other" and first_char in _PAIRS)
        if strong:
            return not (dash and look == "lower")
        if kind in ";\u037e":
            # Only after a Greek word it is a question mark.
            a = self.last_letter(term)
            return a >= begin and ("Ͱ" <= line[a] <= "Ͽ" or "ἀ" <= line[a] <= "῿")
        return look != "lower"

    def point(self, begin: int, term: int, at: int) -> bool:
        """Whether a sentence ends with the single point at ``term``, after which the line goes on at ``at``, after a blank."""
        line = self.line
        first_char = line[at]
        if self.kinds[at] == "k" and first_char not in "—–-":
            return False
        how, look = self.abbreviated(begin, term), self.look(at)
        if how == "never":
            return False
        if how == "figure" and (look == "digit" or (look == "upper" and _ROMAN.match(line, self.next_word(at)))):
            return False
        if how == "figure maybe":
            return look in ("upper", "host")
        if how == "maybe":
            return look in ("upper", "digit", "host") or (look == "other" and first_char in "([“\"«‘„»「¿¡")
        if look == "lower":
            return False
        return not (look == "upper" and self.table.german and self.ordinal(begin, term))


_THAI = re.compile("[\u0e00-\u0e7f]")
_BLANKS = re.compile(r"\s+")


def _thai(ch: str) -> bool:
    return "฀" <= ch <= "๿"


def _line(line: str, table: _Table, terminators: re.Pattern, thai: bool) -> Iterator[tuple[int, int]]:
    """Sentences of one line without line breaks, as offsets in it; ``thai`` is whether there may be Thai in it."""
    line = line.rstrip()
    size = len(line)
    begin = size - len(line.lstrip())
    if begin == size:
        return
    marked = terminators.search(line, begin)
    thai = thai and _THAI.search(line) is not None
    if not thai and (marked is None or marked.end() == size):
        yield begin, size
        return
    body = _HEAD.match(line).end()
    if body >= size:
        body = begin
    spans = _spans(line)
    found = _candidates(line, body, terminators, spans) if marked else ()
    if thai:
        found = sorted([*found, *_thai_blanks(line, body, spans)], key=lambda x: (x[1], x[0]))
    read: _Line | None = None
    head = body  # where the current sentence's own words begin
    for a, b, quoted in found:
        if b <= begin or a < head:
            continue
        if b == size:
            break
        # Most candidates are plain, and what the rules below say of them is known at once.
        if b - a == 1 and quoted is None and (mark := line[a]) in ".!?":
            after = line[b]
            if after == " ":
                after = line[b + 1 : b + 2]
                if after.isupper() and after.isalpha():
                    # A word of no abbreviation and a capital.
                    word = line[line.rfind(" ", head, a) + 1 : a]
                    if mark != "." or (len(word) > 2 and word.isalpha() and word.casefold() not in table.every):
                        yield begin, b
                        begin = head = b + 1
                        if read:
                            read.chains.clear()
                        continue
                elif mark == "." and after.islower():
                    # A small letter that begins no host's name.
                    stop = line.find(" ", b + 1)
                    if line.find(".", b + 1, stop if stop > 0 else size) < 0:
                        continue
            elif mark == "." and (after.islower() or (after.isdigit() and line[a - 1].isdigit())):
                continue  # within a name or a figure
        read = read or _Line(line, table)
        if quoted != _BLANK and not read.ends(head, a, b, quoted):
            continue
        # Signs without a letter or digit belong to the sentence before them, unless a quotation begins with them.
        while True:
            at = _SPACE.match(line, b).end()
            if at < size and read.kinds[at] in "ulon":
                break
            word = read.next_word(at)
            stop = at
            while stop < word and not line[stop].isspace():
                stop += 1
            if stop == at or (stop == word and word < size):
                break
            s = bisect_left(spans, (at, 0))
            if s < len(spans) and spans[s][0] < stop:
                break
            b = stop
        yield begin, b
        read.chains.clear()
        head = begin = _SPACE.match(line, b).end()
        if begin >= size:
            return
    yield begin, size


def _candidates(line: str, body: int, terminators: re.Pattern, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[int, int] | None]]:
    """Runs of terminators outside quotations, with the marks that close after them, and quotations that end with one."""
    s, size = 0, len(line)
    for m in terminators.finditer(line, body):
        a, b = m.span()
        while s < len(spans) and spans[s][1] <= a:
            s += 1
        if s < len(spans) and spans[s][0] < a:
            tail = b
            while tail < spans[s][1] and (line[tail] in _CLOSERS or line[tail].isspace()):
                tail += 1
            if tail == spans[s][1]:
                yield a, tail, spans[s]
            continue
        while b < size and line[b] in _CLOSERS and not (s < len(spans) and spans[s][0] == b) and not (s + 1 < len(spans) and spans[s + 1][0] == b):
            b += 1
        yield a, b, None


#: Stands for a quotation where a blank in Thai is a candidate.
_BLANK = (-1, -1)


def _thai_blanks(line: str, body: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """Blanks in Thai outside quotations and not beside a figure."""
    s = 0
    for m in _BLANKS.finditer(line, body):
        a, b = m.span()
        while s < len(spans) and spans[s][1] <= a:
            s += 1
        if s < len(spans) and spans[s][0] < a:
            continue
        if (_thai(line[a - 1]) or _thai(line[b])) and not line[a - 1].isdigit() and not line[b].isdigit():
            yield a, a, _BLANK


def sentences(text: str | None, language: str | None = None) -> list[tuple[int, int]]:
    """Offsets in code points (from 0, end exclusive) of a text's sentences, without white space at either end.

    ``language`` is a code or name; missing and unknown ones are told from the text. Null, empty and
    blank texts have none. A line break always ends a sentence, so a line of signs without a letter
    or digit is one of its own; within a line they belong to the sentence before them.
    """
    if not text:
        return []
    table, thai = _table(language_of(text, language)), _THAI.search(text) is not None
    terminators = _terminators()[_BEYOND.search(text) is not None]
    return [(m.start() + a, m.start() + b) for m in _LINE.finditer(text) for a, b in _line(m[0], table, terminators, thai)]


def sentence_units(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), language: str | None = None, part_bytes: int = 4 << 20) -> DataFrame:
    """One row per sentence: ``keep``, ``start_char`` and ``end_char``.

    Whole texts are split in one pass without a shuffle; ``language`` names a column with the texts'
    languages, if there is any. Null, empty and blank texts give no row; repeated rows give their
    sentences each time; other columns, whatever their names, are ignored.
    """
    told = F.col(language).cast("string") if language else F.lit(None).cast("string")
    rows = df.select(*keep, F.col(text).cast("string").alias("_text"), told.alias("_language"))
    kept = [f for f in rows.schema.fields if f.name not in ("_text", "_language")]
    schema = T.StructType([*kept, T.StructField("start_char", T.LongType(), False), T.StructField("end_char", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_parts(batch, "_text", part_bytes):
                index, starts, ends = [], [], []
                for i, (t, g) in enumerate(zip(part.column("_text").to_pylist(), part.column("_language").to_pylist(), strict=True)):
                    for a, b in sentences(t, g):
                        index.append(i)
                        starts.append(a)
                        ends.append(b)
                take = pa.array(index, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in keep), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[*keep, "start_char", "end_char"])

    return rows.mapInArrow(run, schema)
