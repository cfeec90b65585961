"""Quantities written in different units: readings of a text, and the unit that fits best.

A unit is segmented by dynamic programming over three tries (prefixes, roots, exponents); every
segmentation gets a score from the prefixes' and roots' frequencies and from the prior of the field
for the dimension it would have, so that "m" is a minute in a field of lengths of time and a metre
in a field of distances. A quantity in turn has several readings where its notation leaves the unit
open (a bare figure, "12:30") or its figure ambiguous ("588,000"); :func:`readings` returns all of
them with their prior, and the caller picks the one that fits other evidence.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache
from typing import NamedTuple


class Trie:
    """A set of spellings with values, for finding all that begin at a place."""

    __slots__ = ("root",)

    def __init__(self, words: Mapping[str, object]) -> None:
        self.root: dict = {}
        for word, value in words.items():
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node.setdefault("", []).append(value)

    def ends(self, text: str, at: int) -> Iterable[tuple[int, object]]:
        node = self.root
        while True:
            for value in node.get("", ()):
                yield at, value
            if at == len(text) or (node := node.get(text[at])) is None:
                return
            at += 1


class Unit(NamedTuple):
    factor: float
    dimension: str
    power: int
    score: float


# Spellings of units. (dimension, factor to the dimension's base unit, whether a symbol takes a prefix)
_ROOTS = {
    ("time", 1.0, True): "s",
    ("time", 1.0, False): 'sec secs second seconds sek seks sekunde sekunden seg segs segundo segundos seconde secondes secondi secondo 秒 秒間 秒钟 秒鐘 сек секунда секунды секунд δευτ δευτερόλεπτα วินาที सेकंड सेकेंड ثانية ثوان ثواني " ″ ” “ \'\' ’’ ′′',
    ("time", 60.0, False): "m min mins mn minute minutes minuten minuto minutos minuti minuta 分 分間 分钟 分鐘 мин минута минуты минут λεπτό λεπτά นาที मिनट دقيقة دقائق ' ′ ’ ‘",
    ("time", 3600.0, False): "h hr hrs hs hour hours std stdn stunde stunden heure heures hora horas ore ora 時 時間 小时 小時 ч час часа часов ώρα ώρες ชั่วโมง घंटा घंटे ساعة ساعات",
    ("time", 86400.0, False): "d day days tag tage tagen jour jours día días dia dias 日 天 день дня дней ημέρα วัน दिन يوم أيام",
    ("length", 1.0, True): "m",
    ("length", 1.0, False): "metre metres meter meters",
    ("length", 0.0254, False): 'in inch inches "',
    ("length", 0.3048, False): "ft foot feet '",
    ("data", 1.0, True): "b",
    ("data", 1.0, False): "byte bytes",
    ("mass", 1.0, True): "g",
    ("mass", 1.0, False): "gram grams gramm gramme grammes",
}
_WORD_ROOTS = {"second", "seconds", "sec", "secs", "sekunde", "sekunden", "segundo", "segundos", "seconde", "secondes", "metre", "metres", "meter", "meters", "byte", "bytes", "gram", "grams"}
_SYMBOL_PREFIXES = {"n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "c": 1e-2, "k": 1e3}
_WORD_PREFIXES = {"nano": 1e-9, "micro": 1e-6, "mikro": 1e-6, "milli": 1e-3, "mili": 1e-3, "centi": 1e-2, "kilo": 1e3, "ミリ": 1e-3, "毫": 1e-3, "милли": 1e-3, "m": 1e-3}
_EXPONENTS = {"": 1, "²": 2, "³": 3, "^2": 2, "^3": 3, "⁻¹": -1, "^-1": -1}

_PREFIX_TRIE = Trie({"": ("", 1.0)} | {p: ("s", f) for p, f in _SYMBOL_PREFIXES.items()} | {p: ("w", f) for p, f in _WORD_PREFIXES.items() if p != "m"})
_ROOT_TRIE = Trie({})
for (_dim, _factor, _symbol), _words in _ROOTS.items():
    for _word in _words.split():
        _node = _ROOT_TRIE.root
        for _ch in _word:
            _node = _node.setdefault(_ch, {})
        _node.setdefault("", []).append((_word, _dim, _factor, _symbol))
_EXPONENT_TRIE = Trie(_EXPONENTS)

#: How likely a quantity of a field has a dimension; for other dimensions OTHER.
LENGTH_OF_TIME = {"time": 0.97}
OTHER = 1e-3
_PREFIX_COST, _STEP_COST = math.log(0.1), math.log(0.05)


#: A unit has at most so many factors ("kg·m²·s⁻³").
_FACTORS = 4


def _decompose(text: str) -> list[dict[tuple, tuple[float, float]]]:
    """For the text up to each place its best segmentations, by dimensions and powers: score and factor. Places that can't be reached are left out at the end."""
    # states[i]: (number of factors, dimensions) to (score, factor)
    states: list[dict[tuple, tuple[float, float]]] = [{(0, ()): (0.0, 1.0)}]
    for at in range(len(text)):
        if at >= len(states):
            break
        if not states[at]:
            continue
        steps = []
        for after_prefix, (kind, scale) in _PREFIX_TRIE.ends(text, at):
            for after_root, (word, dim, factor, symbol) in _ROOT_TRIE.ends(text, after_prefix):
                if after_root == after_prefix or (kind == "s" and not (symbol or word in ("sec", "secs"))) or (kind == "w" and word not in _WORD_ROOTS and word != "秒"):
                    continue
                cost = (_PREFIX_COST if kind else 0.0) + (_PREFIX_COST if scale in (1e-2, 1e3, 1e-9) else 0.0)
                for after, power in _EXPONENT_TRIE.ends(text, after_root):
                    steps.append((after, dim, power, (factor * scale) ** power, cost + (_STEP_COST if power != 1 else 0.0)))
        for (n, dims), (score, total) in states[at].items():
            for after, dim, power, factor, cost in steps if n < _FACTORS else ():
                powers = dict(dims)
                powers[dim] = powers.get(dim, 0) + power
                key = (n + 1, tuple(sorted((d, p) for d, p in powers.items() if p)))
                value = (score + cost + (_STEP_COST if at else 0.0), total * factor)
                while len(states) <= after:
                    states.append({})
                if key not in states[after] or states[after][key][0] < value[0]:
                    states[after][key] = value
    best: list[dict[tuple, tuple[float, float]]] = []
    for found in states:
        merged: dict[tuple, tuple[float, float]] = {}
        for (_, dims), value in found.items():
            if dims not in merged or merged[dims][0] < value[0]:
                merged[dims] = value
        best.append(merged)
    return best


def _rated(found: Mapping[tuple, tuple[float, float]], weights: Mapping[str, float]) -> tuple[Unit, ...]:
    rated = []
    for dims, (score, factor) in found.items():
        if len(dims) == 1:
            (dim, power), = dims
            rated.append(Unit(factor, dim, power, score + math.log(weights.get(dim, OTHER) if power == 1 else OTHER)))
    return tuple(sorted(rated, key=lambda u: -u.score))


def units(text: str, prior: Mapping[str, float] = LENGTH_OF_TIME) -> tuple[Unit, ...]:
    """The readings of a unit's text, the likeliest first; none for a text that is no unit. Case, blanks and closing points don't matter."""
    bare = re.sub(r"[\s.]+", "", text.casefold())
    best = _decompose(bare) if bare else ()
    return _rated(best[len(bare)], prior) if len(best) == len(bare) + 1 else ()


def _seconds(found: tuple[Unit, ...]) -> float | None:
    return found[0].factor if found and found[0].dimension == "time" and found[0].power == 1 else None


def leading_unit(word: str) -> tuple[int, float] | None:
    """The longest beginning of a word that is a unit of time and isn't followed by a letter of the same word: its size and seconds."""
    best = _decompose("".join(ch for ch in word if ch != ".").casefold())
    found, n = None, 0
    for size, ch in enumerate(word, 1):
        n += len(ch.casefold()) if ch != "." else 0
        if n >= len(best):
            break
        if (size == len(word) or not ch.isalpha() or not word[size].isalpha()) and (seconds := _seconds(_rated(best[n], LENGTH_OF_TIME))):
            found = size, seconds
    return found


@lru_cache(maxsize=4096)
def time_unit(text: str) -> float | None:
    """Seconds of a unit of time; None where the likeliest reading is no unit of time."""
    return _seconds(units(text))


class Reading(NamedTuple):
    ms: int
    #: 'written' where the notation tells the unit, else the unit it would be: 'ms', 's', 'min', 'h', 'm:s' or 'h:m'
    unit: str
    prior: float
    #: how far the true value may be from the figure, in ms (a figure in whole minutes may be cut or rounded)
    slack: int


_FRACTIONS = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3}
_ABOUT = re.compile(
    r"^(?:\s|[~≈∼±]|(?:about|approximately|approx|around|roughly|circa|ca|c|etwa|ungefähr|ungef|rund|zirka|env|environ|à peu près|unos|unas|aproximadamente|aprox|cerca de|alrededor de|約|およそ|约|大约|около|примерно|περίπου|ประมาณ|लगभग|حوالي)(?:\.|(?=[\s\d~])))+",
    re.I,
)
_NUMBER = r"\d+(?:[.,'’ \u00a0\u202f]\d{3})+(?![\d])(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
_GLUE = re.compile(r"(?:\s|[,;+·]|-(?=\d)|\b(?:and|und|et|y|e|и|και|と)\b)*", re.I)
_ISO = re.compile(r"p(?:(\d+(?:[.,]\d+)?)w)?(?:(\d+(?:[.,]\d+)?)d)?(?:t(?:(\d+(?:[.,]\d+)?)h)?(?:(\d+(?:[.,]\d+)?)m)?(?:(\d+(?:[.,]\d+)?)s)?)?$", re.I)
_CLOCK = re.compile(r"(\d+)\s*:\s*(\d+)(?:\s*:\s*(\d+))?(?:\s*:\s*(\d+))?(?:[.,](\d+))?\s*(\D*)$")

# Number words of the four word-writing languages, up to twelve and the tens.
_WORDS = {
    0.5: "half demi demie media medio halbe halber halben",
    1: "a an one un une uno una ein eine einer einem", 1.5: "anderthalb eineinhalb", 2: "two zwei deux dos", 3: "three drei trois tres", 4: "four vier quatre cuatro", 5: "five fünf cinq cinco",
    6: "six sechs seis", 7: "seven sieben sept siete", 8: "eight acht huit ocho", 9: "nine neun neuf nueve", 10: "ten zehn dix diez", 11: "eleven elf onze once", 12: "twelve zwölf douze doce",
    13: "thirteen dreizehn treize trece", 14: "fourteen vierzehn quatorze catorce", 15: "fifteen fünfzehn quinze quince", 16: "sixteen sechzehn seize dieciséis", 17: "seventeen siebzehn dix-sept diecisiete", 18: "eighteen achtzehn dix-huit dieciocho", 19: "nineteen neunzehn dix-neuf diecinueve",
    20: "twenty zwanzig vingt veinte", 30: "thirty dreißig dreissig trente treinta", 40: "forty vierzig quarante cuarenta", 50: "fifty fünfzig cinquante cincuenta", 60: "sixty sechzig soixante sesenta", 70: "seventy siebzig soixante-dix setenta", 80: "eighty achtzig quatre-vingts quatre-vingt ochenta", 90: "ninety neunzig quatre-vingt-dix noventa",
}
_VALUE = {w: v for v, words in _WORDS.items() for w in words.split()}
# Words for a hundred.
_HUNDRED = {"hundred", "hundert", "einhundert", "cent", "cents", "cien", "ciento"}
_QUARTERS = {"quarter": 0.25, "quarters": 0.25, "viertel": 0.25, "quart": 0.25, "quarts": 0.25, "cuarto": 0.25, "cuartos": 0.25, "third": 1 / 3, "thirds": 1 / 3}
_OF = {"of", "de", "d", "an", "a", "of-an"}
_AND = {"and", "und", "et", "y", "e"}


def _word_value(word: str) -> float | None:
    if word in _VALUE:
        return _VALUE[word]
    if m := re.fullmatch(r"(\w*?)hundert(?:und)?(\w*)", word):  # zweihundertzehn
        a, b = _VALUE.get(m[1]) if m[1] else 1, _word_value(m[2]) if m[2] else 0
        return a * 100 + b if a is not None and b is not None and 1 <= a < 10 and b < 100 else None
    if m := re.fullmatch(r"(\w+)und(\w+)", word):  # fünfundvierzig
        a, b = _VALUE.get(m[1]), _VALUE.get(m[2])
        return a + b if a and b and a < 10 <= b else None
    if m := re.fullmatch(r"veinti(\w+)", word):
        return 20 + _VALUE[m[1]] if _VALUE.get(m[1], 99) < 10 else None
    parts = [p for p in word.split("-") if p not in _AND]
    if len(parts) == 2 and all(p in _VALUE for p in parts) and _VALUE[parts[0]] >= 20 and _VALUE[parts[1]] < 20:
        return _VALUE[parts[0]] + _VALUE[parts[1]]
    return None


def _spoken(text: str) -> float | None:
    """Seconds of a length in words ("three quarters of an hour", "anderthalb Stunden"), or None."""
    words = re.sub(r"[’'´`]", " ", text.casefold()).replace("demi-heure", "demi heure").split()
    flat: list[str] = []
    for w in words:
        w = w.strip(".,;")
        if m := re.fullmatch(r"(halb|viertel|dreiviertel)(stunden?|minuten?)", w):
            flat += [{"halb": "halbe", "viertel": "viertel", "dreiviertel": "dreiviertel"}[m[1]], m[2]]
        elif w:
            flat.append(w)
    # From each place on, whether a unit follows.
    ahead = [False] * (len(flat) + 1)
    for i in range(len(flat) - 1, -1, -1):
        ahead[i] = ahead[i + 1] or time_unit(flat[i]) is not None
    total, pending, unit, i = 0.0, None, None, 0
    while i < len(flat):
        w = flat[i]
        joined = any(x in _AND for x in flat[max(0, i - 2) : i])
        if w == "dreiviertel":
            pending = 0.75
        elif w in _QUARTERS:
            pending = (pending or 1) * _QUARTERS[w]
            if not ahead[i + 1] and unit:  # "an hour and a quarter"
                total, pending = total + pending * unit, None
        elif w in _HUNDRED and (pending is None or 1 <= pending < 10):
            pending = 100.0 * (pending or 1)
        elif (v := _word_value(w)) is not None:
            following = flat[i + 1] if i + 1 < len(flat) else ""
            if v == 0.5 and not ahead[i + 1] and unit:
                total, pending = total + 0.5 * unit, None  # "an hour and a half", "hora y media"
            elif v == 1 and w in ("a", "an", "un", "une", "una", "ein", "eine") and pending is not None:
                pass  # "half an hour"
            elif pending is not None and pending >= 100 and pending % 100 == 0 and 1 <= v < 100:
                pending += v
            elif pending is not None and pending >= 20 and v < 10:
                pending += v
            elif pending is not None and pending >= 60 and v < 20:
                pending += v
            elif v == 0.5 and pending is not None and joined:
                pending += 0.5  # "two and a half hours"
            elif v == 0.5 and pending == 1:
                pending = 0.5  # "eine halbe Stunde"
            elif v == 1 and following in _QUARTERS:
                pending = 1
            else:
                pending = v
        elif w in _AND or (w in _OF and (pending is not None or unit)):
            pass
        elif (f := time_unit(w)) and len(w) > 1:
            unit = f
            total, pending = total + (1.0 if pending is None else pending) * f, None
        else:
            return None
        i += 1
    return total if unit and pending in (None, 1) and total > 0 else None


def _figures(text: str) -> list[tuple[float, bool, float]]:
    """Values of a figure with separators: (value, whole number?, prior)."""
    text = re.sub(r"[ \u00a0\u202f'’]", "", text)
    marks = re.findall(r"[.,]", text)
    if not marks:
        return [(float(text), True, 1.0)]
    if len(marks) > 1:
        if len(set(marks)) == 1:
            return [(float(re.sub(r"[.,]", "", text)), True, 1.0)]
        head, tail = text[: text.rfind(marks[-1])], text[text.rfind(marks[-1]) + 1 :]
        return [(float(re.sub(r"[.,]", "", head) + "." + tail), False, 1.0)]
    decimal = (float(text.replace(",", ".")), False, 1.0)
    head, tail = re.split(r"[.,]", text)
    if len(tail) == 3 and len(head) <= 3 and head != "0":
        return [decimal, (float(head + tail), True, 0.3 if marks[0] == "." else 0.6)]
    return [decimal]


def _sequence(text: str) -> list[tuple[float, float, float]] | None:
    """(seconds, prior, smallest unit) of "1 h 15 min", "9m9s", "1h04", "5′30″"; None for anything else."""
    at, parts = 0, []
    number, word = re.compile(rf"({_NUMBER})?\s*([½¼¾⅓⅔])?"), re.compile(r"\s*-?\s*([^\d\s,;+½¼¾⅓⅔]+)")
    while at < len(text):
        at = _GLUE.match(text, at).end()
        if at == len(text):
            break
        m = number.match(text, at)
        if m.end() == at or (m[1] is None and m[2] is None):
            return None
        extra = _FRACTIONS.get(m[2], 0.0)
        values = [(v + extra, w and not extra, p) for v, w, p in (_figures(m[1]) if m[1] else [(0.0, True, 1.0)])]
        at = m.end()
        u = word.match(text, at)
        if u:
            if not (led := leading_unit(u[1])):
                return None
            size, factor = led
            at = u.end() - len(u[1]) + size
        elif parts and parts[-1][1] >= 60:
            factor = parts[-1][1] / 60  # "1h04"
        else:
            return None
        if parts and factor >= parts[-1][1]:
            return None
        parts.append((values, factor))
    if not parts:
        return None
    result = [(0.0, 1.0, 0.0)]
    for values, factor in parts:
        single = len(parts) == 1
        result = [
            (s + v * factor, p * q * (20.0 if factor < 1 and whole and len(values) > 1 else 1.0), factor if whole or not single else 0.0)
            for s, p, _ in result
            for v, whole, q in values
        ]
    return result


def readings(text: str | None) -> tuple[Reading, ...]:
    """All readings of a length of time, however long the text. None, empty, unreadable, zero and negative texts have none; "about" and the like are ignored."""
    if text is None:
        return ()
    return _cached(text) if len(text) <= 64 else _readings(text)


def _readings(text: str) -> tuple[Reading, ...]:
    t = "".join(str(unicodedata.decimal(ch)) if ch.isdecimal() else ch for ch in text.strip())
    t = t.replace("：", ":").replace("∶", ":").replace("．", ".").replace("，", ",").strip().strip("()[]").strip()
    t = _ABOUT.sub("", t).strip()
    if not t or t[0] in "-−–":
        return ()
    found: list[tuple[float, str, float, float]] = []  # seconds, unit, prior, slack in seconds
    if m := _ISO.match(t):
        if len(t) > 1 and any(m.groups()):
            seconds = sum(float(x.replace(",", ".")) * f for x, f in zip(m.groups(), (604800, 86400, 3600, 60, 1), strict=True) if x)
            found.append((seconds, "written", 1.0, 1.0))
    elif m := _CLOCK.match(t):
        a, b, c, d, fraction, unit = m.groups()
        part = float(f"0.{fraction}") if fraction else 0.0
        factor = time_unit(unit) if unit.strip(" .") else 0.0
        if factor is None:
            return ()
        if d is not None:
            found.append((float(a) * 86400 + float(b) * 3600 + float(c) * 60 + float(d) + part, "written", 1.0, 1.0))
        elif c is not None:
            found.append((float(a) * 3600 + float(b) * 60 + float(c) + part, "written", 1.0, 1.0))
        elif fraction or factor in (60.0, 1.0):
            found.append((float(a) * 60 + float(b) + part, "written", 1.0, 1.0))
        elif factor == 3600.0:
            found.append((float(a) * 3600 + float(b) * 60, "written", 1.0, 60.0))
        else:
            found.append((float(a) * 60 + float(b), "m:s", 1.0, 1.0))
            found.append((float(a) * 3600 + float(b) * 60, "h:m", 0.05, 60.0))
    elif re.fullmatch(rf"(?:{_NUMBER})\s*[½¼¾]?", t):
        m = re.fullmatch(rf"({_NUMBER})\s*([½¼¾])?", t)
        for v, whole, p in _figures(m[1]):
            v += _FRACTIONS.get(m[2], 0.0)
            whole = whole and not m[2]
            for unit, factor, q in (("s", 1.0, 1.0), ("min", 60.0, 0.3), ("ms", 0.001, 0.1), ("h", 3600.0, 0.02)) if whole else (("min", 60.0, 1.0), ("s", 1.0, 0.5), ("h", 3600.0, 0.1), ("ms", 0.001, 0.001)):
                found.append((v * factor, unit, p * q, factor * (1.0 if whole else 0.1)))
    elif (pairs := _sequence(t)) is not None:
        found += [(s, "written", p, f) for s, p, f in pairs]
    elif (s := _spoken(t)) is not None:
        found.append((s, "written", 1.0, 60.0))
    return tuple(Reading(round(s * 1000), u, p, round(f * 1000)) for s, u, p, f in found if s < 2**53 / 1000 and round(s * 1000) > 0)


#: A cache of short texts, which come again and again.
_cached = lru_cache(maxsize=65536)(_readings)


def mentioned(text: str | None) -> tuple[int, ...]:
    """Milliseconds of the lengths of time, given with a figure and a unit, that a text mentions."""
    if not text:
        return ()
    found = []
    for m in re.finditer(r"(\d+(?:[.,]\d+)?)(?:\s|-|\u00a0)?([^\W\d_]+)", text):
        if f := time_unit(m[2]):
            ms = float(m[1].replace(",", ".")) * f * 1000
            if ms < 2**53:
                found.append(round(ms))
    return tuple(found)


def best(options: Iterable[Reading], low_ms: float | None, high_ms: float | None, mentions: Iterable[int] = (), weight: float = 12.0, usual_ms: tuple[int, int] = (20_000, 21_600_000)) -> tuple[Reading | None, bool]:
    """The reading that fits best, and whether evidence (a range of likely lengths, or lengths mentioned) told it.

    A reading loses ``weight`` times the log of the factor by which it misses the range, and gains
    if a mentioned length is the same up to the figures' coarseness. Without a range, a reading outside
    ``usual_ms`` is unlikely."""
    options = list(options)
    if not options:
        return None, False
    mentions = list(mentions)

    def score(r: Reading) -> float:
        s = math.log(r.prior)
        if low_ms and high_ms:
            below, above = (r.ms + r.slack) / low_ms, r.ms / high_ms
            s += weight * min(0.0, math.log(below)) - weight * max(0.0, math.log(above))
            return s
        if not usual_ms[0] <= r.ms <= usual_ms[1]:
            s -= weight / 2
        if mentions and any(abs(r.ms - x) <= max(r.slack, 60_000 if x % 60_000 == 0 else 1_000) for x in mentions):
            s += weight
        return s

    ranked = sorted(((score(r), -i, r) for i, r in enumerate(options)), reverse=True)
    return ranked[0][2], bool(low_ms and high_ms) or ranked[0][0] > math.log(ranked[0][2].prior) + 1
