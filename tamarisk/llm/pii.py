"""Problem 8, first half: finding personal information in free text. What stands in its place comes from ``surrogates``.

``find_spans`` is one pass of patterns over a whole text. Its spans do not overlap: an email wins over an
identity number, that over a phone number, that over an address, that over a name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.mapping import distance

KINDS = ("email", "id_number", "phone", "address", "name")

# Emails

_LOCAL = r"[^\W_][\w.+\-．＋－]*"
_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
_AT = r"(?:@|＠|&#64;|&#x40;|%40|[ ]?[\[({<][ ]?(?:at|@|arroba)[ ]?[\])}>][ ]?|[ ]@[ ])"
_DOT = r"(?:\.|．|[ ]?[\[({][ ]?(?:dot|punto|\.)[ ]?[\])}][ ]?)"
_EMAIL = re.compile(rf"(?i)(?<![\w.+\-．]){_LOCAL}(?:{_AT}(?:{_LABEL}{_DOT})+[^\W\d_]{{2,}}|[ ](?:at|arroba)[ ]{_LABEL}(?:[ ](?:dot|punto)[ ]{_LABEL})+)(?![\w])")
_EMAIL_SIGNS = ("@", "＠", "&#64;", "&#x40;", "%40", "at)", "at]", "at}", "at>", "at )", "at ]", "arroba", " dot ")

# Identity numbers

_ID_CUE = re.compile(r"(?i)(?:\bssn|social security(?: number)?|social insurance(?: number)?|\bid|\bid\.? (?:no|number|card)|identity card(?: no| number)?|\bdni|\bnif|\bnie|\bcuit|\bcuil|passport|passport (?:no|number)|passeport|pasaporte|insurance|insurance (?:no|number)|tax (?:id|no|number)|ausweis\w*|reisepass\w*|steuer\w*|sécurité sociale|паспорт\w*|снилс|инн|جواز \S+|\bcard of [^\n]{3,50} and the number)[\s.:#№n°º]*$")
# Every pattern of numbers starts by taking a digit (or sign), which the engine can scan for; what must stand before it is looked
# at from there.
_ID = re.compile(
    r"""(?x)\d(?:
      (?<=[A-Za-z]{2}\d)(?<![\w.\-/+][A-Za-z]{2}\d)(?:(?P<ni>\d[  ]?\d{2}[  ]?\d{2}[  ]?[A-Da-d])|(?P<pass>\d{6}))
    | (?<=[A-Za-z]{2}[  ]\d)(?<![\w.\-/+][A-Za-z]{2}[  ]\d)(?:(?P<ni2>\d[  ]?\d{2}[  ]?\d{2}[  ]?[A-Da-d])|(?P<pass2>\d{6}))
    | (?<![\w.\-/+]\d)(?:
        (?P<tax>\d-\d{8}-\d)
      | (?P<ssn>\d{2}(?P<q>[-  –])\d{2}(?P=q)\d{4})
      | (?P<dots>\d?\.\d{3}\.\d{3}(?:-[0-9A-Za-z])?)
      | (?P<cued>\d{3}[  ]\d{6}|\d{6,9}(?:-?[A-Za-z])?)
      )
    )(?![\w]|[.\-–/]\d)"""
)

# Phone numbers

_G = r"[  .\-–‑－]"
_EXT = r"(?:[  ]?(?:ext\.?|x|int\.|доб\.)[  ]?\d{1,5})?"
_PHONE = re.compile(
    rf"""(?x)[+＋(（\d](?:
      (?P<plus>(?<=[+＋])(?<![\w+/=＋][+＋])(?:\d{{10,14}}|\d{{1,3}}(?:{_G}?\(\d{{1,5}}\)|{_G}\d{{1,5}})(?:{_G}?\d{{2,5}}){{1,5}}))
    | (?P<bracket>(?<=[(（])(?<![\w.][(（])\d{{2,5}}[)）]{_G}?(?:\d{{3,4}}{_G}?\d{{3,4}}|\d{{2}}(?:{_G}\d{{2}}){{2,3}}))
    | (?<=\d)(?<![\w.\-–/+]\d)(?:
        (?P<three>\d{{2}}(?P<s>{_G})\d{{3}}(?P=s)\d{{4}})
      | (?P<uk>(?<=0)(?:\d{{4}}{_G}\d{{6}}|\d{{4}}{_G}\d{{3}}{_G}\d{{3}}|\d{{2}}{_G}\d{{4}}{_G}\d{{4}}|\d{{3}}{_G}\d{{3}}{_G}\d{{4}}|\d{{2}}{_G}\d{{5}}{_G}\d{{3}}|\d{{2,4}}/\d{{5,9}}))
      | (?P<pairs>(?<=0)\d(?P<t>{_G})\d{{2}}(?:(?P=t)\d{{2}}){{3}})
      | (?P<bare>\d{{6,13}})
      )
    )(?![\w]|[.\-–/]\d){_EXT}"""
)
_PHONE_CUE = re.compile(
    r"(?i)(?:\b(?:tel|phone|phones|telephone|call|ring|fax|mobile|cell|text|dial|whatsapp|sms|móvil|teléfono|telefono|llamar al|llame al|telefon|tél|téléphone|appelez|anrufen|handy|rufnummer)\b|телефон\w*|звон\w*|тел\.|هاتف|\bmy number)[^\n\d]{0,26}$|(?:next of kin|kin|auprès de|bei)\b[^\n\d]{3,45}, $"
)
_PHONE_AFTER = re.compile(r"(?i)^ (?:is (?:the|my|our) (?:new )?(?:number|phone|mobile|line)|\((?:phone|tel|mobile|cell|home|work)\))")

# Addresses

# Nouns with which street, road and the like form a common word, so that a number before them counts things.
_COMPOUND = "stalls?|food|trips?|snacks?|art|artists?|vendors?|musicians?|markets?|signs?|lamps?|lights?|maps?|tolls?|works?|closures?|races?|dogs?|shows?|parties|names?|corners?|performers?|caf[eé]s?"
_W = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
_TOWN = r"[A-ZÀ-ÞА-Я][^\W\d_]+(?:[ ][A-ZÀ-Þ][^\W\d_]+)?"
_TAIL = rf"(?:(?-i:,\s*\d{{4,5}}\s+{_TOWN}|,?\s+{_TOWN}\s+\d{{4,5}}(?!\d)|,[ \t]+(?!Apt|Tel|My|The|I |And|But){_TOWN}))?"
_STREET = re.compile(
    rf"""(?xi)\d(?<![\w.\-/@]\d)(?:
      (?P<en>\d{{0,3}}[a-z]?(?:-\d{{1,4}})?[  \t]+(?:(?:north|south|east|west|old|new|upper|lower|great|little|[nsew]\.)[  \t]+)?(?!(?:street|road|lane|avenue|court|the|a|of|km|and)\b){_W}[  \t]+
          (?:street|str?|road|rd|lane|ln|avenue|ave?|boulevard|blvd|court|ct|close|drive|way|place|pl|square|sq|terrace|crescent|alley)(?![\w])(?:\.(?=[,.;]|[ ](?-i:[a-z])))?(?![ ](?:{_COMPOUND})\b)
          (?:,?[ \t]*(?:apt|flat|unit|suite|room)\.?[ \t]*\w{{1,4}})?{_TAIL})
    | (?P<fr>\d{{0,3}}(?:[ ]?(?:bis|ter))?,?[  ]+(?-i:rue|avenue|av\.|boulevard|bd|impasse|chemin|place|quai|allée|cours|route|RUE|AVENUE)[  ]+(?:de[ ]la[ ]|de[ ]l['’]|des[ ]|du[ ]|de[ ]|d['’])?(?-i:[A-ZÀ-Þ])[^\W\d_]*(?:[ -](?-i:[A-ZÀ-Þ])[^\W\d_]+)?{_TAIL})
    )"""
)
_STREET_ES = re.compile(
    rf"""(?xi)
      (?P<es>(?<![\w])(?:calle|c/|avenida|avda?\.?|av\.|pje\.?|(?-i:P)(?:asaje|aseo|laza)|bulevar|callejón)[  ]*(?:de(?:l|[ ]la|[ ]los|[ ]las)?[ ]+)?(?!de\b|\d){_W}(?:[ ](?!n\.){_W})?,?[  ]+(?:n\.?[º°o][ ]?|nº[ ]?|\#)?\d{{1,4}}(?![\w])
          (?:,[ ]*(?:piso|depto\.?|dpto\.?|puerta)[ ]*\w{{1,4}})?{_TAIL})
    """
)
_STREET_DE = re.compile(
    rf"""(?xi)
      (?P<de>(?<![\w])(?-i:[A-ZÄÖÜ])[^\W\d_]*-?(?:stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|ufer)[  ]+\d{{1,4}}[a-z]?(?![\w]){_TAIL})
    """
)
_STREET_RU = re.compile(
    rf"""(?xi)
      (?P<ru>(?<![\w])(?:ул\.|улица|проспект|просп\.|пр-т|пр\.|пер\.|переулок|бульвар|шоссе|набережная|наб\.)[  ]*{_W},?[  ]*(?:д\.|дом)?[  ]*\d{{1,4}}[а-я]?(?![\w])(?:,[ ]*(?:кв\.|квартира)[ ]*\d{{1,4}})?(?:,[ ]*(?:г\.[ ]*)?{_TOWN})?)
    """
)
# What such an address begins with (or, the German one, holds); it is looked for first.
_SIGNS_ES = ("calle", "c/", "avenida", "avda", "avd", "av.", "pje", "pasaje", "paseo", "plaza", "bulevar")
_SIGNS_DE = ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ufer")
_SIGNS_RU = ("ул.", "улица", "проспект", "просп.", "пр-т", "пр.", "пер.", "переулок", "бульвар", "шоссе", "набережная", "наб.")


def _streets(text: str, low: str) -> list[re.Match]:
    """The addresses of a text in order."""
    out = list(_STREET.finditer(text))
    for signs, pattern in ((_SIGNS_ES, _STREET_ES), (_SIGNS_RU, _STREET_RU)):
        if len(low) != len(text):  # lower case moved the characters
            out += pattern.finditer(text) if any(x in low for x in signs) else []
            continue
        for sign in signs:
            at = low.find(sign)
            while at >= 0:
                if m := pattern.match(text, at):
                    out.append(m)
                at = low.find(sign, at + 1)
    if any(x in low for x in _SIGNS_DE):
        out += _STREET_DE.finditer(text)
    return sorted(out, key=lambda m: (m.start(), -m.end()))


# Names. Titles, words of places, and capitalised words that are no name part.

TITLES = frozenset("mr mrs ms miss dr dra prof professor herr herrn frau sr sra srta señor señora señorita don doña mme mlle monsieur madame mademoiselle sir lady г-н г-жа господин госпожа".split())
FRENCH_M = re.compile(r"(?i)(?:auprès de|au nom de|chez|de|avec|pour|par|à) $")
PLACE_BEFORE = frozenset("mount lake fort port cape cerro lago puerto cascada villa museo quebrada plaza museum burg mont lac musée vallée chutes château porto monte isla volcán río calle avenida paseo rue avenue pje av hotel hostel station town city".split())
PLACE_AFTER = frozenset("falls ridge bay valley museum gardens garden lake island see tal wasserfall burg street st road rd lane avenue ave court close drive way blvd station hotel park square river beach hill".split())
NO_NAME = frozenset(
    "the a an and or but if at in on of to for from with by as is it its we you they he she i my our your their this that these those there here not no yes dear hi hello hey all list team thanks thank best regards signed please ask tell send call text note notes tip update subject re fwd cc bcc author worker employee photo next contact person guide guest pt patient voucher according between after before around every some most many one two first last once more "
    "mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday jan feb mar apr may jun jul aug sep oct nov dec hours total week todo error warning info debug trace failed passed downloading traceback apt tel id ssn dni "
    "el la los las un una y o de del en por para se según quien entre no las le les un une des du et à au aux on depuis der die das ein eine und oder von wer im am zu auf titular consultas reservas llamar passeport anmeldung ausweisnummer fragen réservations écrire".split()
)
#: Verbs with which a sentence may begin: the first person plural of Spanish by its ending, and words for what was built or is found.
_VERB = re.compile(r"[a-záéíóú]{2,}(?:amos|emos|imos)|built|founded|opened|seen|visit|construit\w*|fondée?|ouvert\w*|construid[oa]s?|fundad[oa]s?|abiert[oa]s?|visit[ée]\w*|gebaut|erbaut|gegründet|besuchen?|построен\w*")
MONTHS = frozenset("january february march april may june july august september october november december enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janvier février mars avril mai juin juillet août septembre octobre novembre décembre januar februar märz juni juli oktober dezember".split())
_SPACE = r"(?:[ \t   ])+"
_GAP = re.compile(rf"(?:{_SPACE}|­)$")
_DOT_GAP = re.compile(rf"\.{_SPACE}?$|\.$")
_COMMA_GAP = re.compile(rf",{_SPACE}$")
_UNIT = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_CUE_BEFORE = re.compile(
    r"(?i)(?:approved by|referred by|signed-off-by:|reviewed-by:|reported by|written by|photo by|worker:|author:|from:|to:|next of kin:|voucher holder|ticket was issued to|issued to|correct the entry of|entry of|the card of|card of|parcel for|ask for|according to|keys back to|(?:our|the|your) guide|la guía|el guía|we asked|contact person:|signed,|regards,|cheers,|preguntar por|titular|au nom de|auprès de|ausgestellt auf|anmeldung bei|name:|patient|\bpt)\s+$"
)
#: What people and no things do, after their name.
_DOES = r"can be reached|will (?:call|meet|wait|write|reply|sign)|has (?:asked|written|called|confirmed|replied|signed)|is (?:waiting|away|on leave|on holiday)|was (?:born|hired)|said|says|wrote|writes|asked|asks|called|calls|told|tells|meets|met|waits|lives|answered|replied|confirmed|signed|(?:le |la |les |lo )?(?:espera|dijo|escribió|llamó|preguntó|vive|atiende|confirmó)|(?:vous )?(?:attend|écrit|appelle|habite|confirme)|(?:a )(?:dit|écrit|confirmé)|sagte|schrieb|wartet|wohnt"
_CUE_AFTER = re.compile(rf"(?i)^(?:\s+/\s+(?:SSN|id|DNI)\b|\s+(?:{_DOES})\b|\s*<[^>\s]+@|,\s+(?:passport|social security|DNI|id|tel|born|aged)\b|\s+\([^)\s]+@)")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


def _capital(w: str) -> bool:
    return len(w) > 1 and w[0].isupper() and (w[1:].islower() or w.isupper() or "-" in w or "'" in w or "’" in w)


@lru_cache(maxsize=100_000)
def _like(word: str, words: frozenset[str]) -> bool:
    """The word is one of ``words``, or one of five letters or more with a single typing error, or of four with two swapped."""
    if word in words or len(word) < 4:
        return word in words
    return any(abs(len(w) - len(word)) < 2 and len(w) > 3 and distance(word, w, 1) < 2 and (len(w) > 4 and len(word) > 4 or sorted(w) == sorted(word)) for w in words)


def find_names(text: str, known: frozenset[str], taken: Callable[[int, int], bool]) -> Iterator[Span]:
    """Names of two parts or more, and family names after a title. ``known``: lower-cased name parts."""
    units = [(m.start(), m.end(), m.group()) for m in _UNIT.finditer(text)]
    n = len(units)

    def gap(i: int) -> str:
        return text[units[i][1] : units[i + 1][0]] if i + 1 < n else "\n"

    def is_known(w: str) -> bool:
        return all(p in known for p in w.lower().split("-")) if "-" in w else w.lower() in known

    def half_known(w: str) -> bool:
        low = w.lower()
        return low in known or ("-" in low and any(p in known for p in low.split("-")) and not any(p in PLACE_AFTER for p in low.split("-")))

    def able(w: str) -> bool:
        low = w.lower()
        return _capital(w) and low not in NO_NAME and low not in TITLES and not (_VERB.fullmatch(low) and low not in known) and not any(p in PLACE_AFTER for p in low.split("-")) and (is_known(w) or not _like(low, PLACE_BEFORE))

    def initial(i: int) -> bool:
        w = units[i][2]
        return len(w) == 1 and w.isupper() and i + 1 < n and bool(_DOT_GAP.match(gap(i)))

    def place(i: int, k: int) -> bool:
        if i and _GAP.match(gap(i - 1)):
            before = units[i - 1][2].lower()
            if _like(before, PLACE_BEFORE) or (before in ("de", "of", "d", "la", "du") and i > 1 and units[i - 2][2].lower() in (PLACE_BEFORE | MONTHS)):
                return True
        return k + 1 < n and bool(_GAP.match(gap(k))) and _like(units[k + 1][2].lower(), PLACE_AFTER) and units[k + 1][2][0].isupper()

    def cued(i: int, k: int) -> bool:
        s, e = units[i][0], units[k][1]
        return bool(_CUE_BEFORE.search(text[max(0, s - 40) : s])) or bool(_CUE_AFTER.match(text[e : e + 60]))

    def alone(i: int, k: int) -> bool:
        """The pair is all that stands in its line."""
        s, e = units[i][0], units[k][1]
        a, b = text.rfind("\n", 0, s), text.find("\n", e)
        return not text[a + 1 : s].strip(" \t\r﻿") and not text[e : len(text) if b < 0 else b].strip(" \t\r")

    def pair(i: int) -> int | None:
        """Index of the last unit of the name that starts at ``i``."""
        a = units[i][2]
        if initial(i):
            b = units[i + 1][2]
            if able(b) and not place(i, i + 1) and (half_known(b) or cued(i, i + 1)):
                return i + 1
            return None
        if i + 1 >= n or len(a) < 2:
            return None
        g = gap(i)
        if _GAP.match(g):
            k = i + 1
            if initial(k) and k + 1 < n:
                k += 1
            b = units[k][2]
            if len(b) < 2:
                return None
            if is_known(a) and is_known(b) and (a[0].isupper() == b[0].isupper()):
                return None if place(i, k) else k
            if able(a) and able(b) and (a.isupper() == b.isupper()):
                if (half_known(a) or half_known(b)) and not place(i, k):
                    return k
                if (cued(i, k) or k > i + 1) and not place(i, k):
                    return k
            return None
        if _COMMA_GAP.match(g):
            b = units[i + 1][2]
            if len(b) > 1 and (a[0].isupper() == b[0].isupper()) and not place(i, i):
                if is_known(a) and is_known(b) or (able(a) and able(b) and (half_known(a) or half_known(b)) and (cued(i, i + 1) or alone(i, i + 1))) or (able(a) and able(b) and _CUE_BEFORE.search(text[max(0, units[i][0] - 40) : units[i][0]])):
                    # "A B, C D" is two names: the second word may start one of its own
                    if i + 2 < n and _GAP.match(gap(i + 1)) and is_known(units[i + 2][2]) and units[i + 2][2][0].isupper():
                        return None
                    return i + 1
        return None

    done = 0
    # Only capitals, known parts and titles can start a name.
    for i in [i for i, (_, _, w) in enumerate(units) if not w[0].islower() or (low := w.lower()) in known or low in TITLES]:
        s, e, w = units[i]
        if i < done or taken(s, e):
            continue
        low = w.lower()
        if i + 1 < n and (low in TITLES and re.fullmatch(rf"\.?{_SPACE}", gap(i)) or w == "M" and re.fullmatch(rf"\.{_SPACE}", gap(i)) and FRENCH_M.search(text[max(0, s - 12) : s])):
            j = i + 1
            if not taken(*units[j][:2]) and (able(units[j][2]) or is_known(units[j][2]) or (initial(j))):
                k = pair(j)
                k = j if k is None or "," in text[units[j][0] : units[k][1]] else k
                if len(units[k][2]) > 1:
                    yield Span("name", units[j][0], units[k][1])
                    done = k + 1
                    continue
        if w[0].isupper() or low in known:
            k = pair(i)
            if k is not None and not any(taken(*units[x][:2]) for x in range(i, k + 1)):
                yield Span("name", s, units[k][1])
                done = k + 1


def _digit_neighbours(text: str, s: int, e: int) -> bool:
    """The span stands among other groups of digits, as in a row of numbers."""
    return bool(re.search(r"[\d④][  ]$", text[max(0, s - 2) : s])) or bool(re.match(r"[  ][\d④]{2}", text[e : e + 3]))


def find_spans(text: str | None, known: frozenset[str]) -> list[Span]:
    """All personal data of a text in order, without overlaps; offsets count code points from 0."""
    if not text:
        return []
    for blank in ("&nbsp;", "\\u00a0"):
        text = text.replace(blank, " " * len(blank))  # escapes of a blank, offsets unchanged
    spans: list[Span] = []
    covered: set[int] = set()

    def taken(s: int, e: int) -> bool:
        return s in covered or e - 1 in covered

    def put(kind: str, s: int, e: int) -> None:
        if not taken(s, e):
            spans.append(Span(kind, s, e))
            covered.update(range(s, e))

    low = text.lower()
    if any(x in low for x in _EMAIL_SIGNS):
        for m in _EMAIL.finditer(text):
            put("email", *m.span())
    for m in _ID.finditer(text):
        s, e = m.span()
        kind = next(k for k in ("ni", "pass", "ni2", "pass2", "tax", "ssn", "dots", "cued") if m.group(k) is not None)
        s -= {"ni": 2, "pass": 2, "ni2": 3, "pass2": 3}.get(kind, 0)
        kind = kind.rstrip("2")
        before = text[max(0, s - 80) : s]
        sure = kind in ("tax", "dots") or kind in ("ni", "pass") and text[s : s + 2].isupper() or kind == "ssn" and not _digit_neighbours(text, s, e)
        if sure or _ID_CUE.search(before):
            put("id_number", s, e)
    mails = {sp.end for sp in spans if sp.kind == "email"}
    for m in _PHONE.finditer(text):
        s, e = m.span()
        form = next(k for k in ("plus", "bracket", "three", "uk", "pairs", "bare") if m.group(k) is not None)
        if form == "bare":
            if not (any(s - len(x) in mails and text.startswith(x, s - len(x)) for x in (" / ", " أو ")) or _PHONE_CUE.search(text[max(0, s - 60) : s]) or _PHONE_AFTER.match(text[e : e + 30])):
                continue
        elif form in ("three", "uk", "pairs") and _digit_neighbours(text, s, m.end(form)) and not _PHONE_CUE.search(text[max(0, s - 60) : s]):
            continue
        put("phone", s, e)
    for m in _streets(text, low):
        put("address", *m.span())
    for sp in find_names(text, known, taken):
        put(sp.kind, sp.start, sp.end)
    return sorted(spans, key=lambda x: x.start)


def name_parts(names: DataFrame, most: int = 200_000) -> frozenset[str]:
    """The lower-cased name parts of a list (column ``name``), which every task gets; more than ``most`` are refused."""
    got = [r.n for r in names.where("name IS NOT NULL").select(F.lower(F.trim("name")).alias("n")).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"more than {most} name parts")
    return frozenset(x for x in got if x)
