"""Personal information inside free text: detection, typed placeholders and keyed surrogates.

A surrogate has the type, format, script and, for names, the gender of what it replaces. It is
drawn with a secret key from the canonical form of the entity, so that all mentions of one entity
get one surrogate; entities whose surrogates collide are drawn again until all are distinct. The
parts of a name are drawn each from its own, so a title with a family name gets the family name
that the full name gets.

Which words are given and family names is learned from the texts: what stands where people say a
name seeds two lists, and pairs of neighbours extend each by the other, as long as most of a word's
uses are in names. A word that the texts hardly use otherwise is taken for a family name next to a
learned given name.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import Scratch, spread

TYPES = ("email", "phone", "id_number", "address", "person_name")
DRAWS = 50  # rounds of drawing again before what is left is numbered: draw DRAWS + n is the n-th numbered surrogate

TITLES = {"mr": "m", "mrs": "f", "ms": "f", "miss": "f", "mme": "f", "mlle": "f", "madame": "f", "monsieur": "m", "herr": "m", "frau": "f", "sr": "m", "sra": "f", "srta": "f", "senor": "m", "senora": "f", "senhor": "m", "senhora": "f", "sig": "m", "sig.ra": "f", "signor": "m", "signora": "f", "dr": "", "dra": "f", "prof": "", "m": "m"}
#: Words that follow a title or a given name at the start of the next clause and are no family name.
NOT_FAMILY = set("could please thank thanks station hello hallo hola your you the this that they there our and are was were has have had will would can not for with from come still seatback wait call message good morning ciao buenas bonjour guten nous wir gracias merci vielen obrigado grazie never any ugh update also when what why who how seats seat refund weather".split())
# What a person says before a full name, in six languages.
NAME_CUES = "my name is|name is|booked for|booked under|the passenger is|passenger|bag of|the name of|in the name of|dear|me llamo|mi nombre es|a nombre de|je m'appelle|mon nom est|au nom de|mein name ist|ich heisse|auf den namen|gebucht auf|il mio nome e|mi chiamo|a nome di|meu nome e|o meu nome e|me chamo|em nome de|signed,|please page"
# The commonest given names and family names of six languages, found together in any case and order.
COMMON_GIVEN = {
    "m": "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory alexander frank patrick raymond jack dennis peter henry simon oliver harry jose juan carlos luis miguel jesus pedro manuel antonio francisco alejandro javier fernando sergio rafael diego pablo jorge roberto eduardo jean pierre michel philippe alain nicolas laurent julien francois louis antoine guillaume hans klaus jurgen wolfgang dieter stefan andreas markus matthias tobias florian sebastian lukas felix giuseppe giovanni marco luca francesco alessandro andrea matteo lorenzo davide paolo stefano joao jose pedro tiago bruno ricardo rui nuno".split(),
    "f": "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia kathleen amy angela anna emma olivia nicole samantha katherine christine helen rachel maria carmen ana isabel lucia elena marta pilar rosa teresa cristina paula raquel beatriz marie sophie nathalie isabelle catherine sylvie camille chloe julie claire ursula monika petra sabine andrea claudia heike katrin anja giulia francesca chiara sara valentina silvia federica elisa martina joana ines catarina mariana fernanda juliana".split(),
}
COMMON_FAMILY = set("smith johnson williams brown jones miller davis wilson anderson taylor thomas moore jackson martin lee thompson white harris clark lewis robinson walker allen wright hill green adams nelson baker hall campbell mitchell carter roberts evans turner phillips parker edwards collins stewart morris murphy cook rogers morgan cooper peterson bailey reed kelly howard ward watson brooks bennett gray hughes price myers foster sanders ross powell sullivan russell patel khan garcia rodriguez martinez hernandez lopez gonzalez gonzales perez sanchez ramirez torres flores rivera gomez diaz cruz morales reyes gutierrez ortiz ramos ruiz alvarez fernandez jimenez moreno romero vazquez castro dubois durand leroy moreau laurent lefebvre michel bertrand roux fournier girard bonnet dupont lambert fontaine rousseau muller schmidt schneider fischer weber meyer wagner becker schulz hoffmann schafer koch bauer richter klein wolf schroder neumann schwarz zimmermann braun kruger hartmann lange rossi russo ferrari esposito bianchi romano colombo ricci marino greco conti gallo costa mancini lombardi silva santos oliveira souza rodrigues ferreira alves pereira lima carvalho almeida ribeiro martins rocha sousa".split())
#: What surrogates call people, by gender; every name of the lists above, so that no list is needed beside them.
SURROGATE_GIVEN = {g: [n for n in dict.fromkeys(names) if not any(n in other for h, other in COMMON_GIVEN.items() if h != g)] for g, names in COMMON_GIVEN.items()}
STREETS_EN = "street|st|avenue|ave|road|rd|lane|ln|boulevard|blvd|court|ct|terrace|drive|dr|way|place|pl|square|sq|close|crescent|row"

FOLD = {}
for _c in range(0xC0, 0x180):
    _d = unicodedata.normalize("NFD", chr(_c))[0]
    if _d.isascii() and _d.isalpha():
        FOLD[_c] = _d
FOLD |= {0x2019: "'", 0xA0: " ", 0x202F: " ", 0x131: "i", 0x17F: "s", 0x212A: "K"}


def fold(text: str) -> str:
    """Text without accents, character for character, so that positions stay the same."""
    return text if text.isascii() else text.translate(FOLD)


_T = "(?:" + "|".join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True)) + ")"
_CAP = r"[A-Z][a-z]+(?:['-][A-Z]?[a-z]+)*|[A-Z]{3,}(?:['-][A-Z]+)*"
_W2 = r"[a-z]{2,}(?:['-][a-z]{2,})*"

_CG = {n: g for g, names in COMMON_GIVEN.items() for n in names}
_PAIR = re.compile(rf"(?<![\w@/#.-])(?=({_W2})(,?)\s+(?:[a-z]\.?\s+)?({_W2})(?![\w-]))")
_SLASH = re.compile(rf"\b({_W2})\s?/\s?({_W2})(?:\s+(?:mr|mrs|ms|miss|dr|mstr)\b)?")
_TITLE = re.compile(rf"\b({_T})\.?\s+({_W2})(?:\s+({_W2}))?\b")
_CUE = re.compile(rf"\b(?:{NAME_CUES})\s+(?:{_T}\.?\s+)?({_W2})(?:\s+[a-z]\.?)?\s+({_W2})")
_TRAVEL = re.compile(rf"\b({_W2})/({_W2})\s+(mr|mrs|ms|miss|dr|mstr)\b")
_NO_NAME = NOT_FAMILY | set(TITLES) | set(re.findall(r"[a-z]+", NAME_CUES))

_USE = re.compile(rf"(?<![\w@.+/-]){_W2}(?![\w@+-]|\.\w|\s?[(\[{{]\s?at)")  # a word in a sentence, not a part of a mail address or a link
#: names of no known parts: only in capitals, and only after a cue or a title
NAMES_OPEN = [
    re.compile(rf"(?:(?i:\b(?:{NAME_CUES}))\s+)((?:{_CAP})\s+(?:[A-Z]\.?\s+)?(?:{_CAP}))\b"),
    re.compile(rf"(?:(?i:\b(?:{NAME_CUES}))\s+)((?:{_CAP}),\s+(?:{_CAP}))\b"),
    re.compile(r"(?<![/\w])((?:Mr|Mrs|Ms|Miss|Mme|Mlle|M(?=\.)|Herr|Frau|Sra?|Srta|Dra?|Prof|Sig(?:\.ra)?)\.?\s+(?:[A-Z][a-z]+(?:['-][A-Z]?[a-z]+)*))\b"),
    re.compile(r"\b([A-Z]{2,}(?:[-'][A-Z]+)*/[A-Z]{2,}\s+(?:MR|MRS|MS|MISS|DR|MSTR))\b"),
]

COUNTED = 500_000  # words and pairs that a task counts before it passes them on
FAMILY_SHARE, GIVEN_SHARE = 0.5, 0.03  # of a word's texts, those where it is a family name, or a given name before one
TURNS = 4  # in which the two lists extend each other


class Names:
    """Learned given names, family names, and the other words that the texts use."""

    def __init__(self, given: frozenset = frozenset(), family: frozenset = frozenset(), words: frozenset = frozenset(), genders: dict[str, str] | None = None):
        self.given, self.family, self.words, self.genders = given, family, words, genders or {}
        self.any_given, self.any_family = given | set(_CG), family | COMMON_FAMILY

    def is_family(self, w: str) -> bool:
        """Whether a word next to a learned given name is its family name: a known one, or a word of no other use."""
        return w in self.any_family or len(w) > 3 and bool(self.words) and w not in self.words and w not in _NO_NAME and w not in self.given

    def find(self, t: str, low: str, words: set[str]) -> list[tuple[int, int]]:
        """(start, end) of names in a folded text, given its lower case and the words of that."""
        out = []
        if not self.any_given.isdisjoint(words):
            for m in _PAIR.finditer(low):
                a, b = m.group(1), m.group(3)
                if m.group(2):
                    hit = b in self.given and self.is_family(a) or b in _CG and a in self.any_family
                else:
                    hit = a in self.given and self.is_family(b) or a in _CG and b in self.any_family or b in self.given and a in self.family
                if hit:
                    out.append((m.start(1), m.end(3)))
            for m in _SLASH.finditer(low) if "/" in low else ():
                if m.group(2) in self.any_given and self.is_family(m.group(1)):
                    out.append((m.start(), m.end()))
        if not self.any_family.isdisjoint(words):
            for m in _TITLE.finditer(low):
                last = 2 if m.group(2) in self.family else 3 if m.group(3) in self.family and m.group(2) in self.any_given else 0
                if last:
                    out.append((m.start(), m.end(last)))
        for rx in NAMES_OPEN if not _CUE_WORDS.isdisjoint(words) or _TITLED.search(t) or "/" in t and _SLASHED.search(t) else ():
            for m in rx.finditer(t):
                parts = re.findall(r"[A-Za-z'-]+", m.group(1))
                if rx is NAMES_OPEN[2] and parts[0] == "M" and (not self.words or parts[-1].lower() in self.words):
                    continue  # an initial, unless the next word has no other use
                if rx is NAMES_OPEN[3] or parts[-1].lower() not in NOT_FAMILY and parts[0].lower() not in NOT_FAMILY and len(parts[-1]) >= 3:
                    out.append((m.start(1), m.end(1)))
        return out


def counted(texts, pieces: "Pieces | None" = None) -> Counter:
    """How many texts hold each (kind, a, b): a word as a use or in a family name's place, a given name
    with the gender of its title, and pairs of neighbours, forwards and with a comma backwards.

    Texts are counted by their pieces, which repeat; patterns run over a whole text only where a
    piece shows that one could match."""
    pieces = Pieces() if pieces is None else pieces
    out, uses, pairs, backs = Counter(), [], [], []
    for text in texts:
        flags, used, near, back, before, initial = 0, set(), set(), set(), (), False
        for f, words, tails, head, letter in map(pieces.__getitem__, text.split()):
            flags |= f
            used.update(words)
            if before and head:
                for w, comma in before:
                    (back if comma else near).add((head, w) if comma else (w, head))
            if letter and not initial:
                initial = True  # what stands before an initial also meets what comes after it
            else:
                before, initial = tails, False
        if flags:
            low = fold(text).lower()
            if flags & _BRACKET:
                used = set(_USE.findall(low))
            travel = [m.groups() for m in _TRAVEL.finditer(low)] if flags & _TRAVELS == _TRAVELS else []
            cues = ([m.groups() for m in _CUE.finditer(low)] if flags & _CUED else []) + [(g, f) for f, g, _ in travel]
            titles = [m.group(1, 2) for m in _TITLE.finditer(low)] if flags & _BEFORE_NAME else []
            out.update({("seed", f, "") for _, f in cues} | {("seed", w, "") for _, w in titles})
            out.update([("titled", w, TITLES[t]) for t, w in titles] + [("titled", g, TITLES.get(t, "")) for _, g, t in travel])
            near.update(cues)
        uses += used
        pairs += near
        backs += back
    out.update({("use", w, ""): n for w, n in Counter(uses).items()})
    out.update({("pair", *ab): n for ab, n in Counter(pairs).items()})
    out.update({("back", *ab): n for ab, n in Counter(backs).items()})
    return out


def learn(texts: list[str]) -> Names:
    """Given and family names of texts, and the words that are neither; see the module's head."""
    return names_of(counted(texts).items())


def names_of(counts) -> Names:
    """Names by the ((kind, a, b), n) of counted()."""
    total, seeds, pairs, back, titled = ({} for _ in range(5))
    for (kind, a, b), n in counts:
        if kind in ("use", "seed"):
            (total if kind == "use" else seeds)[a] = n
        else:
            (pairs if kind == "pair" else back if kind == "back" else titled)[a, b] = n
    total, titled = Counter(total), Counter(titled)
    families = lambda c: {w for w, n in c.items() if len(w) > 2 and n / max(total[w], 1) >= FAMILY_SHARE and w not in _NO_NAME}
    names, family = set(), families(seeds)
    for _ in range(TURNS):
        given = Counter()
        for (a, b), n in pairs.items():
            if b in family:
                given[a] += n
        names = {w for w, n in given.items() if n > 1 and n / max(total[w], 1) >= GIVEN_SHARE and w not in family and w not in _NO_NAME}
        seen = Counter(seeds)
        for both in (pairs, back):
            for (a, b), n in both.items():
                if a in names:
                    seen[b] += n
        family = families(seen) - names
    genders = {w: "m" if titled[w, "m"] > titled[w, "f"] else "f" for w in names if titled[w, "m"] != titled[w, "f"]}
    return Names(frozenset(names), frozenset(family), frozenset(w for w, n in total.items() if n > 1 and w not in family), genders)


_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|punto|point|ponto)\s?[)\]}]\s?|\s+(?:dot)\s+)"
EMAIL = [
    re.compile(rf"(?i)(?<![\w.+-])[a-z0-9](?:[\w.+'-])*(?:\s?@\s?|\s?[(\[{{]\s?at\s?[)\]}}]\s?)[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+"),
    re.compile(r"(?i)(?<![\w.+-])[a-z0-9][\w.+'-]*\s+at\s+[a-z0-9-]+(?:(?:\s+dot\s+|\s?[(\[]\s?dot\s?[)\]]\s?)[a-z0-9-]+)+"),
]

_S = r"[\s  .-]"
PHONE = [
    re.compile(rf"(?<![\w+.-])\+\d{{1,3}}(?:{_S}?\(?\d{{1,4}}\)?){{2,6}}(?:\s?(?:ext|x)\.?\s?\d+)?(?![\w-])"),
    re.compile(rf"(?<![\w+.-])00\d{{2}}(?:[ -]\d{{2,5}}){{2,4}}(?![\w-])"),
    re.compile(rf"(?<![\w+.-])(?:1{_S})?(?:\(\d{{3}}\)\s?|\d{{3}}{_S})\d{{3}}{_S}\d{{4}}(?:\s?(?:ext|x)\.?\s?\d+)?(?![\w-])"),
    re.compile(r"(?<![\w+.-])0\d{2}[  ]\d{4}[  ]\d{4}(?![\w-])"),
    re.compile(r"(?<![\w+.-])0\d{4}[  ]\d{6}(?![\w-])"),
    re.compile(r"(?<![\w+.-])0\d{2}[  /-]\d{5}[  -]\d{3}(?![\w-])"),
    re.compile(r"(?<![\w+.-])0\d(?:[  .-]\d{2}){4}(?![\w-])"),
    re.compile(r"(?<![\w+.-])[1-9]\d{9}(?![\w-])"),
]
#: numbers that are no telephone numbers though they look like one, by the word before them
NOT_PHONE = re.compile(r"(?i)(?:tag|case|ticket|order|no\.?|ref(?:erence)?|booking|number of|expediente|vorgang|dossier|caso|pratica|bag|flight|steuer-id|cpf|ssn|social|id)\W{0,3}$")

ID = [
    re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    re.compile(r"(?i)\b(?:ssn|social(?: security)?(?: (?:number|no\.?))?)\W{0,3}\d{3}[ -]?\d{2}[ -]?\d{4}(?!\d)"),
    re.compile(r"(?<![\w+.-])[1-9]\d{2}[  ]\d{2}[  ]\d{4}(?![\w-]|[  ]\d)"),
    re.compile(r"(?<![\w+.-])9\d{8}(?![\w-])"),
    re.compile(r"(?i)\b(?:national (?:id|identity)(?: (?:number|no\.?|card))?)\W{0,3}\d{4}[  ]?\d{4}[  ]?\d{4}\b"),
    re.compile(r"(?<![\w.-])(?<!\d )\d{4} \d{4} \d{4}(?! ?\d)(?![\w-])"),
    re.compile(r"(?<![\w-])[A-Z]\d{3}-\d{4}-\d{4}(?![\w-])"),
    re.compile(r"(?i)\b(?:passport|passeport|pasaporte|passaporto|passaporte|reisepass)(?:\s?(?:number|no\.?|n[°ºo]\.?|numero|num\.?|nr\.?|nummer))?\W{0,3}(?=[a-z0-9]*\d)[a-z0-9]{7,10}\b"),
    re.compile(r"(?i)\b(?:driv(?:er'?s?|ing) licen[cs]e|permiso de conducir|permis de conduire|fuhrerschein|patente)(?:\s?(?:number|no\.?|n[°ºo]\.?|nr\.?))?\W{0,3}(?=[a-z0-9-]*\d)[a-z0-9-]{6,16}\b"),
    re.compile(r"(?i)\b(?:dni|nie|nif)\W{0,3}[xyz]?\d{7,8}(?:-?[a-z])?\b"),
    re.compile(r"(?<![\w.-])0\d{7}-?[A-Z](?![\w-])"),
    re.compile(r"(?<![\w.-])[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}(?!\w)"),
    re.compile(r"(?i)\b(?:steuer-?id(?:entifikationsnummer)?|steuernummer)\W{0,3}\d{2} ?\d{3} ?\d{3} ?\d{3}\b"),
    re.compile(r"(?<![\w.-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-])"),
    re.compile(r"(?i)\b(?:ausweis(?:nummer|nr\.?)?|personalausweis(?:nummer)?)\W{0,3}(?=[a-z0-9]*\d)[a-z0-9]{8,10}\b"),
    re.compile(r"(?i)(?<![\w-])[a-z]{6}\d{2}[a-z]\d{2}[a-z]\d{3}[a-z](?![\w-])"),
    re.compile(r"(?i)(?<![\w/-])(?:[a-z]{2}\d{6,7}|\d{2}[a-z]{2}\d{5}|[cfghjklmnprtvwxyz]\d[cfghjklmnprtvwxyz]\d{6})(?![\w-])"),
]
#: what a text must hold, in lower case, for the patterns above that ask for a label
_ID_LABELS = {1: ("ssn", "social"), 4: ("national",), 7: ("pass", "pasaporte"), 8: ("licen", "permis", "fuhrerschein", "patente"), 9: ("dni", "nie", "nif"), 12: ("steuer",), 14: ("ausweis",)}
#: letters and digits of the number itself, after its label
_LABEL = re.compile(r"(?i)^(?:[a-z'°º]+(?:\.(?=\s|[a-z]\.)|-id\b)?(?:\s|\W(?=\s))+)*(?:n[°ºo]\.?\s*|no\.\s*|[a-z-]+\W+(?=\S*\d))*")

_ES = r"(?:calle|c/|avda\.?|avenida|paseo|plaza|camino)"
_FR = r"(?:rue|impasse|avenue|chemin|allee|quai|boulevard|place|cours|route)"
_IT = r"(?:via|viale|piazza|corso|vicolo|largo|strada)"
_PT = r"(?:rua|travessa|avenida|av\.|largo|praca|estrada|alameda)"
_W = r"[a-z][a-z'-]+"
ADDRESS = [
    re.compile(rf"(?i)(?:\b(?:flat|apt\.?|apartment|unit)\s+\d+[a-z]?,\s*)?(?<![\w$€£.,#-])\d{{1,5}}[a-z]?\s+(?:[nsew]\.?\s+)?(?:{_W}\s+){{1,3}}?(?:{STREETS_EN})\b(?:\.(?=,))?(?:,\s*(?:apt\.?|flat)\s*\d+[a-z]?)?(?!\s+\d{{1,3}}\s+is\b)"),
    re.compile(rf"(?i)(?<![\w/])(?:{_ES})\s+(?:{_W}\s+){{1,4}}?(?:n[°ºo]\.?\s*)?\d{{1,5}}[a-z]?\b(?:,\s*\d{{1,2}}[º°]\s?[a-z]\b)?"),
    re.compile(rf"(?i)(?<![\w$€£.,])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+{_FR}\s+(?:(?:de la|de l'|des|du|de)\s*)?{_W}(?:\s+{_W})?"),
    re.compile(rf"(?i)\b{_IT}\s+(?:(?:della|dello|delle|dei|degli|del|di|dell')\s*)?(?:{_W}\s+){{1,3}}?\d{{1,4}}[a-z]?\b"),
    re.compile(rf"(?i)\b{_PT}\s+(?:{_W}\s+){{1,4}}?\d{{1,5}}\b|\b{_PT}\s+(?:{_W}\s+){{0,3}}{_W},\s*(?:n[°ºo]\.?\s*)?\d{{1,5}}\b(?:,\s*apto\.?\s*\d+)?"),
    re.compile(r"(?i)\b[a-z-]{3,}(?:stra(?:ss|ß)e|str\.|weg|gasse|platz|allee|ufer|damm|steig)\s+\d{1,4}\s?[a-z]?\b"),
]
STREET_FIRST = re.compile(rf"(?i)(?:(?:{_W}\s+){{1,3}}(?:{STREETS_EN}),\s*(?:apt\.?|flat)\s*\d+[a-z]?)")
#: cheap tests that a text could hold what the patterns above look for
_NUMBER = re.compile(r"\d(?:(?:[\s().+-]{0,3}\d){6}|[a-z]{1,2}\d{3}|[a-z0-9]{7})")
_CODE = re.compile(r"[a-z]\d\d(?:\d{3}|[a-z]\d\d)")
_PAPERS = ("passp", "pasap", "passap", "licen", "permiso de", "permis de", "patente", "reisepass", "schein", "ausweis")
_MAIL = re.compile(r"@\s?[a-z0-9-]+(?:\.[a-z0-9]|\s?[(\[{]|\s+dot\s)|[(\[{]\s?at\s?[)\]}]")
_DIGIT = re.compile(r"\d")
_WORD = re.compile("[a-z]{2,}")
_STREET_WORDS = [frozenset(re.findall("[a-z]{2,}", x)) for x in (STREETS_EN, "calle avda avenida paseo plaza camino", _FR, _IT, _PT)]
_GERMAN = re.compile(r"(?:stra(?:ss|ß)e|str\.|weg|gasse|platz|allee|ufer|damm|steig)\s+\d")
_CUE_WORDS = frozenset(max(re.findall("[a-z]{2,}", c), key=lambda w: (w != "please", len(w))) for c in NAME_CUES.split("|"))
_WORDS = re.compile("[a-z]+")
_TITLED = re.compile(r"\b(?:M\.|(?:Mr|Mrs|Ms|Miss|Mme|Mlle|Herr|Frau|Sra?|Srta|Dra?|Prof|Sig)\b)")
_SLASHED = re.compile(r"[A-Z]/[A-Z]{2}")
#: words that make "<number> <words> <street word>" something else than an address
NOT_STREET = re.compile(r"(?i)\b(?:hours?|minutes?|days?|times?|people|row|half|pour|the|is|of|me|made|sick|voyage|bag|bags|seats?|fois|for|in|at|terminal|gate|belt|and|to|from|this|that|a|an|on|by|or|our|my|your|la|le)\b")
_FRENCH_PLACE = re.compile(r"(?i)\d+\s+place\s")


PIECES, LONGEST = 200_000, 64  # pieces that a task remembers, and the length up to which it does
LONGEST_TITLE = max(map(len, TITLES)) + 2  # with a full stop and what stands before it

#: what a piece of a text, as white space parts it, can be a part of
_BRACKET, _TRAVEL_NAME, _TRAVEL_TITLE, _CUED, _BEFORE_NAME, _AT, _HAS_DIGIT, _CODED, _ENDS_NUMBER, _STARTS_NUMBER, _HOUSE, _STREET, _STREET_EN, _GIVEN, _FAMILY, _NAMED = (1 << i for i in range(16))
_TRAVELS, _NUMBERS, _TITLED_FAMILY, _HOUSE_EN = _TRAVEL_NAME | _TRAVEL_TITLE, _ENDS_NUMBER | _STARTS_NUMBER, _FAMILY | _BEFORE_NAME, _HOUSE | _STREET_EN
_TAIL = re.compile(rf"(?<![\w@/#.-])(?=({_W2})(,?)\Z)")
_HEAD = re.compile(rf"({_W2})(?![\w-])")
_LETTER = re.compile(r"[a-z]\.?\Z")
_ENDS_TRAVEL = re.compile(rf"\b{_W2}/{_W2}\Z")
_TRAVEL_TITLES = frozenset("mr mrs ms miss dr mstr".split())
_STARTS_TITLE = re.compile(rf"(?:{'|'.join(sorted(_TRAVEL_TITLES))})\b")
_ENDS_TITLE = re.compile(rf"\b{_T}\.?\Z")
_MAIL_PIECE = re.compile(r"@(?:[a-z0-9-]+[.(\[{]|\Z)|dot|[(\[{]")
_ENDS_DIGIT, _STARTS_DIGIT = re.compile(r"\d[().+-]*\Z"), re.compile(r"[().+-]*\d")
_ENDS_HOUSE = re.compile(r"(?<![\w$€£.,#-])\d{1,5}[a-z]?\Z")
_GERMAN_ENDINGS = ("strasse", "straße", "str.", "weg", "gasse", "platz", "allee", "ufer", "damm", "steig")
_PAPER_PIECES = tuple(p.split(" ")[0] for p in _PAPERS)
_OTHER_STREETS = frozenset().union(*_STREET_WORDS[1:], ("apt", "flat"))
_ZEROS = str.maketrans("123456789", "000000000")


class _Remembered(dict):
    """Pieces of texts with what of() finds in them; no pattern in it looks beyond a piece, or tells digits apart."""

    def __missing__(self, piece: str):
        shape = piece.translate(_ZEROS)
        if shape in self:
            return self[shape]
        got = self.of(shape)
        if len(shape) <= LONGEST:
            if len(self) >= PIECES:
                self.clear()
            self[shape] = got
        return got


class Pieces(_Remembered):
    """For counted(): flags, uses, words at the end (with whether a comma follows), a word at the start, and whether it is an initial."""

    def of(self, piece: str) -> tuple:
        low = fold(piece).lower()
        if low.isascii() and low.isalpha():
            flags = _TRAVEL_TITLE * (low in _TRAVEL_TITLES) | _CUED * (low in _CUE_WORDS) | _BEFORE_NAME * (low in TITLES)
            return (flags, (low,), ((low, False),), low, False) if len(low) > 1 else (flags, (), (), None, True)
        flags = _BRACKET * ("(" in low or "[" in low or "{" in low) | _TRAVEL_NAME * bool("/" in low and _ENDS_TRAVEL.search(low)) | _TRAVEL_TITLE * bool(_STARTS_TITLE.match(low))
        flags |= _CUED * (not _CUE_WORDS.isdisjoint(_WORDS.findall(low))) | _BEFORE_NAME * bool(_ENDS_TITLE.search(low[-LONGEST_TITLE:]))
        head = _HEAD.match(low)
        return flags, tuple(_USE.findall(low)), tuple((m.group(1), bool(m.group(2))) for m in _TAIL.finditer(low)) if low[-1].isalpha() or low[-1] == "," else (), head and head.group(1), bool(_LETTER.match(low))


class Gate(_Remembered):
    """Which texts detect() could find something in."""

    def __init__(self, names: "Names"):
        super().__init__()
        self.names = names

    def of(self, piece: str) -> int:
        t = fold(piece)
        low = t.lower()
        words = set(_WORD.findall(low))
        flags = _GIVEN * (not self.names.any_given.isdisjoint(words)) | _FAMILY * (not self.names.any_family.isdisjoint(words)) | _BEFORE_NAME * bool(_ENDS_TITLE.search(low[-LONGEST_TITLE:]))
        flags |= _NAMED * bool(not _CUE_WORDS.isdisjoint(words) or t != low and _TITLED.search(t) or "/" in t and _SLASHED.search(t))
        flags |= _STREET_EN * (not _STREET_WORDS[0].isdisjoint(words)) | _STREET * bool(not _OTHER_STREETS.isdisjoint(words) or "c/" in low or low.endswith(_GERMAN_ENDINGS))
        flags |= _AT * bool(_MAIL_PIECE.search(low)) | _CODED * any(p in low for p in _PAPER_PIECES)
        if _DIGIT.search(low):
            flags |= _HAS_DIGIT | _CODED * bool(_CODE.search(low) or _NUMBER.search(low)) | _ENDS_NUMBER * bool(_ENDS_DIGIT.search(low)) | _STARTS_NUMBER * bool(_STARTS_DIGIT.match(low)) | _HOUSE * bool(_ENDS_HOUSE.search(low))
        return flags

    def opens(self, text: str) -> bool:
        """False only where detect() finds nothing."""
        flags = 0
        for f in map(self.__getitem__, text.split()):
            flags |= f
        if flags & (_GIVEN | _NAMED) or flags & _TITLED_FAMILY == _TITLED_FAMILY:
            return True
        if flags & _HAS_DIGIT and (flags & (_CODED | _STREET) or flags & _HOUSE_EN == _HOUSE_EN):
            return True
        if flags & _AT or flags & _NUMBERS == _NUMBERS:
            low = fold(text).lower()
            return bool(flags & _AT and ("dot" in low or _MAIL.search(low)) or flags & _NUMBERS == _NUMBERS and _NUMBER.search(low))
        return False


BASE = Names()  # before anything is learned: common names, cues and titles


def _put(out: list, used: list, start: int, end: int, kind: str) -> None:
    if all(end <= a or start >= b for a, b in used):
        used.append((start, end))
        out.append((start, end, kind))


def detect(text: str | None, names: Names = BASE) -> list[tuple[int, int, str]]:
    """(start, end, type) of each piece of personal information, in order and without overlaps."""
    if not text:
        return []
    t = fold(text)
    low = t.lower()
    out: list[tuple[int, int, str]] = []
    used: list[tuple[int, int]] = []
    words = set(_WORD.findall(low))
    if "dot" in low or _MAIL.search(low):
        for rx in EMAIL:
            for m in rx.finditer(t):
                _put(out, used, m.start(), m.end(), "email")
    digit = _DIGIT.search(low)
    if digit and (_NUMBER.search(low) or _CODE.search(low) or any(x in low for x in _PAPERS)):
        for k, rx in enumerate(ID):
            if k in _ID_LABELS and not any(x in low for x in _ID_LABELS[k]):
                continue
            for m in rx.finditer(t):
                if re.search(r"(?i)(?:tag|case|ticket|order(?: no\.?)?|no\.)\s*$", t[max(0, m.start() - 10) : m.start()]):
                    continue
                label = _LABEL.match(m.group())
                start = m.start() + (label.end() if label and label.end() < len(m.group()) and any(c.isdigit() for c in m.group()[label.end() :]) else 0)
                _put(out, used, start, m.end(), "id_number")
        for rx in PHONE:
            for m in rx.finditer(t):
                n = sum(c.isdigit() for c in m.group())
                if not 9 <= n <= 19 or NOT_PHONE.search(t[max(0, m.start() - 14) : m.start()]):
                    continue
                _put(out, used, m.start(), m.end(), "phone")
    if digit:
        for k, rx in enumerate(ADDRESS):
            if _STREET_WORDS[k].isdisjoint(words) and not (k == 1 and "c/" in low) if k < 5 else not _GERMAN.search(low):
                continue
            for m in rx.finditer(t):
                s = m.group()
                if k == 0 and NOT_STREET.search(re.sub(r"(?i)^(?:flat|apt\.?|apartment|unit)\s+\S+\s*", "", s)):
                    continue
                if k == 2 and _FRENCH_PLACE.search(s):
                    continue
                _put(out, used, m.start(), m.end(), "address")
        for m in STREET_FIRST.finditer(t) if "apt" in words or "flat" in words else ():
            _put(out, used, m.start(), m.end(), "address")
    for lo, hi in names.find(t, low, words):
        _put(out, used, lo, hi, "person_name")
    return sorted(out)


# ---- surrogates

# Streets by the language of the address they stand in for, and syllables for families.
STREET_NAMES = {"en": "Fernhollow|Coldbrook|Hazelwick|Stonemere|Larkfield|Ottervale|Brackenford|Willowmead", "es": "Almendral|Castañar|Robledal|Fuensanta|Encinar|Torreón|Olmeda|Peñalta", "de": "Ahornfeld|Birkenau|Eschenbach|Lindenhof|Tannenberg|Weiden|Erlen|Rosen", "fr": "Peupliers|Noyers|Fontaines|Coquelicots|Saules|Bruyères|Érables|Lavandes", "it": "Cipressi|Ginestre|Pioppi|Querce|Mirti|Tigli|Allori|Oleandri", "pt": "Oliveiras|Pinheiros|Amendoeiras|Laranjeiras|Jasmins|Acácias|Cerejeiras|Figueiras"}
SYLLABLES = "ba be bi bo da de di do fa fe fi fo ga ge go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo".split()
ENDINGS = "len mar dor wick nell rand sen vik ton gard".split()


def canonical(kind: str, value: str) -> str:
    """The form in which all mentions of one entity agree, whatever their spelling and layout."""
    v = fold(value).lower()
    if kind == "email":
        v = re.sub(r"\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+|\s?@\s?", "@", v)
        return re.sub(r"\s?[(\[{]\s?(?:dot|punkt|punto|point|ponto)\s?[)\]}]\s?|\s+dot\s+", ".", v)
    if kind == "phone":
        return re.sub(r"\D", "", re.sub(r"\(0\)|(?:ext|x).*", "", v)).lstrip("0")
    if kind == "id_number":
        return re.sub(r"[^a-z0-9]", "", v)
    if kind == "person_name":
        words = re.findall(r"[a-z]+(?:-[a-z]+)*", v)
        return " ".join(sorted(w for w in words if w not in TITLES and len(w) > 1 and w != "mstr"))
    return " ".join(re.findall(r"[a-z0-9]+", v))


class Keyed:
    """A stream of choices that depends on the key, the entity and the number of the draw."""

    def __init__(self, key: bytes, kind: str, entity: str, draw: int):
        self.number = draw - DRAWS if draw >= DRAWS else None
        self.bits = int.from_bytes(hmac.new(key, f"{kind}|{draw}|{entity}".encode(), hashlib.sha512).digest(), "big")

    def pick(self, n: int) -> int:
        self.bits, r = divmod(self.bits, n)
        return r


def _like(word: str, as_word: str) -> str:
    """word in the capitals of as_word."""
    return word.upper() if as_word.isupper() and len(as_word) > 1 else word if as_word.islower() else word.capitalize()


def _family(k: Keyed) -> str:
    if k.number is not None:  # another for each number, and longer than any that is drawn
        n, digits = k.number, []
        while n or len(digits) < 4:
            n, d = divmod(n, len(SYLLABLES))
            digits.append(SYLLABLES[d])
        return "".join(digits) + ENDINGS[0]
    return "".join(SYLLABLES[k.pick(len(SYLLABLES))] for _ in range(3)) + ENDINGS[k.pick(len(ENDINGS))]


def _counted(number: int, value: str, start: int, end: int, letters: bool) -> str:
    """value with its digits, and its letters if wanted, counting up between start and end; what does not fit is added in digits."""
    out = list(value)
    for i in range(end - 1, start - 1, -1):
        c = value[i]
        if c.isdigit():
            number, d = divmod(number, 10)
            out[i] = str(d)
        elif letters and c.isascii() and c.isupper():
            number, d = divmod(number, 26)
            out[i] = chr(ord("A") + d)
    return "".join(out[:end]) + (str(number) if number else "") + value[end:]


def surrogate(kind: str, value: str, key: bytes, draw: int = 0, genders: dict[str, str] | None = None) -> str:
    """A replacement of the same type and format; value is how the entity is written here.

    genders says whether a given name is a man's or a woman's (m, f), beside those known by the lists;
    a title in one mention does not decide, as all mentions must get the same name.
    """
    k = Keyed(key, kind, canonical(kind, value), draw)
    if kind in ("phone", "id_number"):
        # digits for digits and letters for letters; the separators and a country code stay
        keep = re.match(r"\+\d{1,2}|00\d{2}", value) if kind == "phone" else None
        n = keep.end() if keep else 0
        if k.number is not None:
            ext = re.search(r"(?i)\s?(?:ext|x)", value) if kind == "phone" else None
            return _counted(k.number, value, n, ext.start() if ext else len(value), kind == "id_number")
        return value[:n] + "".join(str(k.pick(10)) if c.isdigit() else (chr(ord("A") + k.pick(26)) if c.isupper() else c) if c.isascii() and c.isalpha() and kind == "id_number" else c for c in value[n:])
    if kind == "email":
        local = SYLLABLES[k.pick(len(SYLLABLES))] + SYLLABLES[k.pick(len(SYLLABLES))] + "." + _family(k) + str(k.pick(1000))
        at = re.search(r"\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+|\s?@\s?", value, re.I).group()
        dot = re.search(r"\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+", value, re.I)
        return (local.upper() if value.isupper() else local) + at + "example" + (dot.group() if dot else ".") + "org"
    if kind == "person_name":
        words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", value)
        plain = [fold(w).lower() for w in words]
        gender = next((x for w in plain if (x := (genders or {}).get(w, _CG.get(w)))), "")
        pool = SURROGATE_GIVEN[gender] if gender else sum(SURROGATE_GIVEN.values(), [])
        known = [w in _CG and not (w in COMMON_FAMILY and len(plain) > 1) for w in plain]
        slash = "/" in value
        roles = []
        for j, w in enumerate(words):
            if plain[j] in TITLES and len(words) > 1 or len(w) == 1:
                roles.append("")
            elif known[j] or not any(known) and (slash and j == 1 or not slash and (j == 0 and "," not in value or j == len(words) - 1 and "," in value) and len(words) > 1 and plain[0] not in TITLES):
                roles.append("given")
            else:
                roles.append("family")
        if k.number is not None and "family" not in roles:  # only a family name can carry a number
            roles[max((j for j, x in enumerate(roles) if x), default=-1)] = "family"
        out, last = [], 0
        for j, m in enumerate(re.finditer(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", value)):
            w = m.group()
            part = Keyed(key, roles[j], plain[j] if k.number is None else canonical(kind, value), draw)
            rep = _like(pool[part.pick(len(pool))], w) if roles[j] == "given" else _like(_family(part), w) if roles[j] else w
            out += [value[last : m.start()], rep]
            last = m.end()
        return "".join(out) + value[last:]
    f = fold(value).lower()
    lang = next((l for l, rx in (("es", _ES), ("fr", _FR), ("it", _IT), ("pt", _PT)) if re.search(rf"(?:^|\s|\d\s){rx}\s", f)), "de" if re.search(r"(?:stra(?:ss|ß)e|str\.|weg|gasse|platz|allee|ufer|damm|steig)\s+\d", f) else "en")
    names = STREET_NAMES[lang].split("|")
    street = names[k.pick(len(names))] + ("" if lang == "de" else " ") + _family(k).capitalize()
    kept = re.compile(rf"(?i)^(?:{STREETS_EN}|flat|apt\.?|apartment|unit|apto|[nsew]\.?|{_ES}|{_FR}|{_IT}|{_PT}|de|la|del|des|du|da|do|dos|das|della|dei|bis|ter|n[°ºo]\.?|[a-z]|[º°])$")
    out, last, put = [], 0, False
    for m in re.finditer(r"[^\W\d_]+(?:[./'’-][^\W\d_]*)*|\d+", value):
        w = fold(m.group()).rstrip(".")
        out.append(value[last : m.start()])
        last = m.end()
        ending = re.search(r"(?i)(?:stra(?:ss|ß)e|str\.|weg|gasse|platz|allee|ufer|damm|steig)$", fold(m.group())) if lang == "de" else None
        if w.isdigit():
            out.append(str(1 + k.pick(9)) + "".join(str(k.pick(10)) for _ in m.group()[1:]))
        elif ending:
            out.append(street.replace(" ", "") + m.group()[ending.start() :])
        elif kept.match(w):
            out.append(m.group())
        elif not put:
            out.append(_like(street, m.group()) if not m.group()[0].isupper() or m.group().isupper() else street)
            put = True
        else:
            out[-1] = out[-1].rstrip() if not out[-1].strip() else out[-1]
    if k.number is not None and not put:
        out.append(" " + street)
    return "".join(out) + value[last:]


# ---- plans

FOUND = "src string, record_id long, text string, pii_type string, at int, until int, value string, entity string, surrogate string"


def _scan(names: Names, key: bytes):
    def run(batches):
        gate = Gate(names)
        for b in batches:
            src, ids, texts = (b.column(c).to_pylist() for c in ("src", "record_id", "text"))
            rows = [(s, i, t, k, lo, hi, t[lo:hi], canonical(k, t[lo:hi]), surrogate(k, t[lo:hi], key, 0, names.genders)) for s, i, t in zip(src, ids, texts) if gate.opens(t) for lo, hi, k in detect(t, names)]
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _count(batches):
    counts, pieces = Counter(), Pieces()
    for b in batches:
        counts.update(counted(b.column("text").to_pylist(), pieces))
        if len(counts) > COUNTED:
            yield _counts(counts)
            counts.clear()
    yield _counts(counts)


def _counts(counts: Counter) -> pa.RecordBatch:
    kind, a, b = zip(*counts) if counts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(counts.values(), pa.int64())], names=["kind", "a", "b", "n"])


def learned(rows: DataFrame) -> Names:
    """Names learned from all texts, counted in the tasks; the driver gets a row for each word and pair of neighbours."""
    counts = spread(rows.where("text <> ''").select("text")).mapInArrow(_count, "kind string, a string, b string, n long")
    got = counts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).toArrow()
    return names_of((tuple(k), n) for batch in got.to_batches() for *k, n in zip(*(batch.column(i).to_pylist() for i in range(4))))


def secret(rows: DataFrame) -> bytes:
    """The key of surrogates: the session's skein.surrogate.key, or where it is unset a new one for each
    run, so that nobody who reads this code can undo them."""
    named = rows.sparkSession.conf.get("skein.surrogate.key", None)
    return named.encode() if named else secrets.token_bytes(32)


def records(twcs: DataFrame, golden: DataFrame) -> DataFrame:
    """(src, record_id, text) of messages and of labelled answers; rows without an id are dropped."""
    t = twcs.select(F.lit("twcs").alias("src"), F.col("tweet_id").cast("long").alias("record_id"), "text")
    g = golden.select(F.lit("golden").alias("src"), F.col("id").cast("long").alias("record_id"), F.col("brand_reply").alias("text"))
    return t.unionAll(g).where("record_id is not null")


def entities(rows: DataFrame, names: Names | None = None, key: bytes | None = None) -> DataFrame:
    """One row for each piece found in (src, record_id, text): its type, place, value, entity and the
    surrogate that is drawn for it first.

    Null and empty texts hold none. Repeated rows are searched each; an empty table gives none.
    """
    return spread(rows.where("text <> ''")).mapInArrow(_scan(names or learned(rows), key or secret(rows)), FOUND)


def found(rows: DataFrame, names: Names | None = None) -> DataFrame:
    """(src, record_id, pii_type), each once, of the pieces that a surrogate takes the place of."""
    return entities(rows, names).where("surrogate <> value").select("src", "record_id", "pii_type").distinct()


def _draw(key: bytes, genders: dict[str, str]):
    def run(frames):
        for f in frames:
            f["surrogate_key"] = [canonical(k, surrogate(k, v, key, d, genders)) for k, v, d in zip(f["pii_type"], f["value"], f["draw"])]
            yield f[["pii_type", "entity", "value", "draw", "surrogate_key"]]

    return run


def draws(ents: DataFrame, key: bytes, scratch: Scratch, rounds: int = DRAWS, genders: dict[str, str] | None = None) -> DataFrame:
    """(pii_type, entity, draw): which draw each entity uses, so that no two share a surrogate.

    Of entities that collide the first keeps its surrogate and the others are drawn again, only
    against what is settled; entities are compared by the canonical form of their surrogates. What is
    left after the rounds is numbered by type, past every number used before, and checked the same
    way until nothing is left; so many numbers cannot all be taken.
    """
    todo = scratch.save(ents.groupBy("pii_type", "entity").agg(F.min("value").alias("value")).withColumn("draw", F.lit(0)), "entities")
    settled, turn, used = None, 0, 0
    while True:
        turn += 1
        made = scratch.save(todo.mapInPandas(_draw(key, genders or {}), "pii_type string, entity string, value string, draw int, surrogate_key string"), "made")
        ranked = made.withColumn("n", F.row_number().over(Window.partitionBy("pii_type", "surrogate_key").orderBy("entity")))
        # a surrogate must not be the name of a real entity either
        real = ents.select("pii_type", F.col("entity").alias("surrogate_key"), F.lit(True).alias("real")).distinct()
        ranked = ranked.join(real, ["pii_type", "surrogate_key"], "left")
        if settled is not None:
            ranked = ranked.join(settled.select("pii_type", "surrogate_key", F.lit(True).alias("taken")), ["pii_type", "surrogate_key"], "left")
        else:
            ranked = ranked.withColumn("taken", F.lit(None).cast("boolean"))
        ranked = scratch.save(ranked.withColumn("ok", (F.col("n") == 1) & F.col("real").isNull() & F.col("taken").isNull()), "ranked")
        good = ranked.where("ok").select("pii_type", "entity", "draw", "surrogate_key")
        settled = good if settled is None else scratch.save(settled.unionAll(good), "settled")
        todo = ranked.where("not ok").select("pii_type", "entity", "value", (F.col("draw") + 1).alias("draw"))
        left = todo.groupBy("pii_type").count().agg(F.max("count")).first()[0]
        if not left:
            return settled
        if turn >= rounds:
            number = F.row_number().over(Window.partitionBy("pii_type").orderBy("entity")) + used
            todo = scratch.save(todo.withColumn("draw", (F.lit(DRAWS - 1) + number).cast("int")), "numbered")
            used += left


def _rewrite(key: bytes, genders: dict[str, str]):
    def run(frames):
        for f in frames:
            masked, replaced = [], []
            for text, pieces in zip(f["text"], f["pieces"]):
                m, r, last = [], [], 0
                for p in sorted(pieces, key=lambda p: p["at"]):
                    keep = text[last : p["at"]]
                    v = text[p["at"] : p["until"]]
                    m += [keep, f"<{p['pii_type']}>"]
                    r += [keep, surrogate(p["pii_type"], v, key, p["draw"], genders)]
                    last = p["until"]
                masked.append("".join(m) + text[last:])
                replaced.append("".join(r) + text[last:])
            f["masked"], f["surrogates"] = masked, replaced
            yield f[["src", "record_id", "masked", "surrogates"]]

    return run


def replaced(rows: DataFrame, key: bytes | None = None, scratch: Scratch | None = None, names: Names | None = None) -> DataFrame:
    """(src, record_id, masked, surrogates) of each distinct text that holds personal information.

    masked has a placeholder that names the type in place of each piece, surrogates a keyed
    replacement; the rest of the text is untouched. Two mentions of an entity get the same
    surrogate, two entities never do. Texts without personal information are not in the result.
    """
    scratch = scratch or Scratch(rows.sparkSession, "private")
    key, names = key or secret(rows), names or learned(rows)
    ents = scratch.save(entities(rows, names, key).distinct(), "found")
    chosen = draws(ents, key, scratch, genders=names.genders).select("pii_type", "entity", "draw")
    whole = ents.join(chosen, ["pii_type", "entity"]).groupBy("src", "record_id", "text").agg(F.collect_list(F.struct("pii_type", "at", "until", "draw")).alias("pieces"))
    return whole.mapInPandas(_rewrite(key, names.genders), "src string, record_id long, masked string, surrogates string")
