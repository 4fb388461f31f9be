"""Personal information in free text: found by anchors, bounded by local parsers, replaced by typed placeholders.

One Aho-Corasick pass over the lower-cased text finds anchors: at-signs and their spellings, identifier cues, street
words, titles, phrases that introduce persons, and the tokens of the name lexicon. Runs of digits anchor numbers.
Deterministic parsers expand each anchor to both sides, validate it and give its exact bounds; of overlapping cases the
longer one stands. Name words that the lexicon lacks are judged by their letter trigrams, with a classifier fitted on
the lexicon against the common words of all texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skarn.session import cut
from skarn.skew import hashed_sample

#: Tokens, about, of a lexicon that are broadcast (of a larger one the others count for the classifier as well, and are
#: joined to the texts that hold them).
LEXICON_LIMIT = 200_000

# Words and phrases that mark anchors, in lower case.
AT_MARKS = ["@", " at ", "(at)", "[at]", "{at}", "( at )", "[ at ]"]
ID_CUES = [
    "ssn", "social security", "national insurance", "ni number", "ni no", "passport", "driver's licence", "driver's license", "driver licence", "driver license", "drivers licence", "drivers license", "driving licence", "driving license",
    "licence no", "license no", "licence number", "license number", "personal number", "personal no", "personal id", "national id", "identity number", "identity card", "id card", "tax id", "personnummer",
]
PHONE_CUES = ["phone", "tel", "telephone", "mobile", "call", "cell", "fax", "telefon", "telefonisch", "appelez", "téléphone", "teléfono", "telefono", "llame", "電話", "电话", "unter", "anruf", "ruf"]
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "professor", "herr", "frau", "mme", "mlle", "monsieur", "madame", "sr", "sra", "señor", "señora", "sir", "mx"]
NAME_CUES = [
    "signed-off-by:", "reviewed-by:", "acked-by:", "tested-by:", "reported-by:", "co-authored-by:", "@author", "author:", "maintainer:", "owner:", "contact:", "customer:", "reviewer:", "assignee:", "this week:",
    "name=", "user=", '"user":', '"name":', '"author":', '"owner":', "cc ", "talked to ", "spoke to ", "spoke with ", "ask ", "thanks to ", "thank ", "demandez à ", "pregunte a ", "relu par ", "revisado por ", "geprüft von ", "mit ", "écrivez à ",
    "as ", "担当は", "请联系", "联系", "written by ", "from ", "by ", "and ", "to ", "/ ", "| ", "escriba a ", "schreiben sie an ", "demander à ", "contactez ", "contacte a ", "según ", "selon ", "laut ",
]
#: Cues after which a single word that only looks like a name is one.
WEAK_CUES = {"as ", "by ", "from ", "and ", "to ", "/ ", "| ", "mit ", "ask ", "cc ", '"name":', "name=", "owner:", '"owner":'}
STREET_WORDS = [
    "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "court", "ct", "boulevard", "blvd", "way", "place", "pl", "terrace", "square", "sq", "crescent", "close", "row", "parkway", "pkwy", "highway", "hwy", "circle", "trail", "alley", "walk", "grove",
]
ABBREVIATIONS = {"st", "rd", "ave", "ln", "dr", "ct", "blvd", "pl", "sq", "pkwy", "hwy"}
# Further names of streets, which are words of their own as well: a postcode has to follow.
STREET_WORDS_WITH_CODE = [
    "gardens", "garden", "green", "hill", "mews", "park", "rise", "view", "wharf", "yard", "gate", "quay", "vale", "villas", "mount", "bank", "fields", "meadow", "meadows", "heights", "ridge", "point", "plaza", "loop",
    "pike", "turnpike", "causeway", "passage", "parade", "approach", "broadway", "bridge", "common", "croft", "cross", "drove", "esplanade", "end", "hollow", "landing", "manor", "orchard", "path", "run", "spur", "trace", "glen",
]
ITALIAN_WAYS = ["via", "viale", "piazza", "piazzale", "corso", "largo", "vicolo", "strada", "rua", "avenida", "praça", "travessa", "alameda"]
DUTCH_ENDS = ["straat", "gracht", "laan", "plein", "kade", "dijk", "singel", "gatan", "vägen", "gade", "vej", "veien", "gata", "katu", "tie"]
FRENCH_WAYS = ["rue", "avenue", "chemin", "boulevard", "place", "allée", "impasse", "quai", "route", "cours", "passage", "sentier", "square"]
SPANISH_WAYS = ["calle", "avenida", "plaza", "paseo", "camino", "carrera", "ronda", "travesía", "callejón", "glorieta"]
GERMAN_ENDS = ["straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer", "steig", "pfad", "markt", "chaussee"]
GERMAN_LEADS = ["Am", "An der", "An den", "Im", "In der", "In den", "Zum", "Zur", "Auf dem", "Auf der", "Unter den", "Beim", "Hinter der", "Vor dem"]
BOXES = ["p.o. box", "po box", "p. o. box", "p.o.box", "postfach", "apartado", "boîte postale", "post office box", "casilla"]

_B = r"(?<![^\W_])"  # no letter or digit before
_S = r"(?:[ \t    ]{1,3})"
_SN = r"(?:[ \t   ]{0,3}\n[ \t ]{0,3}|[ \t   ]{1,3})"  # blanks, perhaps with one line break
_UP = "A-ZÀ-ÖØ-ÞŁŚŠŽČĆŐŰ"
_CAP = rf"[{_UP}][^\W_]*(?:['’.-][^\W_]+)*"
_alt = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))

_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_DOT = rf"(?:\.|\s?[\[({{]\s?dot\s?[\])}}]\s?|{_S}dot{_S})"
EMAIL_RIGHT = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
EMAIL_LEFT = re.compile(r"[^\W_][\w.+%'&-]*\Z|\"[^\"\n]{1,64}\"\Z")
LAST_LABEL = re.compile(r"[^\W\d_]{2,24}\Z")

NUMBER = re.compile(r"(?:\+|\()?\d(?:[\d.()  ‑ /-]{5,28})\d")
EXTENSION = re.compile(r"[,;]?\s{0,3}(?:ext\.?|extension|x|ext:|durchwahl|poste|int\.?)\s{0,3}\d{1,6}(?![\w-])", re.I)
_SEP = r"(?:[ .  ‑-]{1,2})"
NANP = re.compile(rf"(?:(?:\+|00)?1{_SEP}?)?(?:\(\d{{3}}\){_SEP}?|\d{{3}}{_SEP})\d{{3}}{_SEP}\d{{4}}")
INTERNATIONAL = re.compile(rf"(?:\+|00)[1-9]\d{{0,2}}(?:{_SEP}?\(0\){_SEP}?)?(?:{_SEP}?\(?\d{{1,5}}\)?){{1,7}}|(?:\+|00)[1-9]\d{{7,14}}")
LOCAL = re.compile(rf"\(?0?\d{{1,5}}\)?(?:{_SEP}\d{{2,5}}){{1,5}}|\d{{7,13}}")

#: National numbers as they are grouped by their countries' plans (United Kingdom, France), which need no cue.
NATIONAL = re.compile(rf"0(?:2\d{_SEP}\d{{4}}{_SEP}\d{{4}}|1\d{{2}}{_SEP}\d{{3}}{_SEP}\d{{4}}|1\d{{3}}{_SEP}\d{{5,6}}|7\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{3}}|7\d{{3}}{_SEP}\d{{6}}|[1-9](?:{_SEP}\d\d){{4}})")
PHONE_CUE = re.compile(rf"(?:{_alt(PHONE_CUES)})[^\w\n]{{0,4}}(?:[^\W\d_]+[^\w\n]{{1,3}}){{0,2}}\Z")
#: Words before digits that are no identity number: of versions, builds and the like.
OTHER_NUMBER = re.compile(r"(?<![^\W_])(?:version|release|revision|build|run|commit|order|invoice|ticket|issue|batch|serial|part|model|page|line|step|seed|port|isbn|issn|card|iban)(?:s|\s+(?:no\.?|number|id))?[\s:#=]{1,3}\Z")
SSN = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}")
SSN_DASHED = re.compile(r"\d{3}[-‑]\d{2}[-‑]\d{4}")
NI = re.compile(rf"{_B}[A-CEGHJ-PR-TW-Zq][A-CEGHJ-NPR-TW-Zq] ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D](?!\w)", re.I)
LICENCE = re.compile(rf"{_B}[A-Z]\d{{3}}[- ]\d{{4}}[- ]\d{{4}}(?![\w-])", re.I)
PASSPORT = re.compile(rf"{_B}[A-Z]{{1,2}}\d{{6,9}}(?!\w)", re.I)
GROUPS_OF_FOUR = re.compile(r"\d{4} \d{4} \d{4}")
ANY_ID = re.compile(r"(?:[A-Z]{1,3}[ -]?)?\d(?:[ -]?\d){4,17}[A-Z]?(?!\w)", re.I)
CUE_GAP = re.compile(r"(?:\s{0,3}(?:number|numbers|no\.?|nr\.?|num\.?|#|card|is|was|id|:|=|->|n[°º])){0,4}\s{0,3}[\"'(]?", re.I)

_UNIT = rf"(?:,?{_SN}(?:#\s?\d+\w?|(?:suite|ste\.?|apt\.?|apartment|unit|flat|floor|room|rm\.?|bldg\.?|building)\s{{1,3}}#?\w{{1,6}}))"
_TOWN = rf"[{_UP}][^\W\d_]+(?:['’-][^\W\d_]+)*(?:{_S}[{_UP}][^\W\d_]+(?:['’-][^\W\d_]+)*){{0,3}}"
_STATE = rf"(?:,?{_SN}[A-Z]{{2}}{_SN}\d{{5}}(?:-\d{{4}})?|,?{_SN}[A-Z]{{1,2}}\d[A-Z\d]?{_S}\d[A-Z]{{2}})"
_CODE = rf"(?:,{_SN}{_TOWN})?(?:,?{_SN}[A-Z]{{2}}{_SN}\d{{5}}(?:-\d{{4}})?|,?{_SN}[A-Z]{{1,2}}\d[A-Z\d]?{_S}\d[A-Z]{{2}})"
_TAIL = rf"(?:,{_SN}(?:\d{{4,6}}{_SN})?{_TOWN})?(?i:{_STATE})?"
ENGLISH = re.compile(rf"{_B}\d{{1,5}}[A-Za-z]?{_SN}(?:{_CAP}{_SN}){{1,5}}(?:{_alt([w.title() for w in STREET_WORDS] + [w.upper() for w in STREET_WORDS])})(?!\w)\.?(?i:{_UNIT})?(?:,{_SN}{_TOWN})?(?:(?i:{_STATE})(?!\w))?")
CODED = re.compile(rf"{_B}\d{{1,5}}[A-Za-z]?{_SN}(?:{_CAP}{_SN}){{0,5}}(?:{_alt([w.title() for w in STREET_WORDS_WITH_CODE])})(?!\w)(?i:{_UNIT})?{_CODE}(?!\w)")
ITALIAN = re.compile(rf"{_B}(?i:{_alt(ITALIAN_WAYS)})(?!\w)(?:{_SN}(?:d[aeio]|del|della|dello|dei|degli|delle|dell['’]|da|do|das|dos|e)(?!\w))*(?:{_SN}{_CAP}){{1,5}},?{_SN}\d{{1,4}}(?:/?[A-Za-z])?(?!\w),{_SN}\d{{4,5}}(?:-\d{{3}})?{_SN}{_TOWN}")
DUTCH = re.compile(rf"{_B}(?:{_CAP}{_S}){{0,2}}[{_UP}][\w-]*(?:{_alt(DUTCH_ENDS)}){_S}\d{{1,4}}{_S}?[a-zA-Z]?(?!\w),{_SN}\d{{3,4}}{_S}?(?:[A-Z]{{2}}|\d{{2}}){_SN}{_TOWN}")
BOX = re.compile(rf"{_B}(?i:{_alt(BOXES)})(?:{_SN}(?:de correos))?{_SN}(?:n[°º.]{_S})?\d{{1,6}}(?:,{_SN}(?:\d{{4,6}}{_SN})?{_TOWN})?(?:(?i:{_STATE})(?!\w))?")
FRENCH = re.compile(rf"{_B}\d{{1,4}}(?:{_S}?(?:bis|ter|quater))?,?{_SN}(?i:{_alt(FRENCH_WAYS)})(?:{_SN}(?:de|du|des|la|le|les|l['’]|d['’]|au|aux|et|à)(?:(?<=['’])|(?!\w)))*(?:{_SN})?(?:[{_UP}][^\W_]*(?:['’-][^\W_]+)*)(?:{_SN}(?:(?:de|du|des|la|le|les)(?!\w){_SN})*(?:[{_UP}][^\W_]*(?:['’-][^\W_]+)*)){{0,4}}(?:,{_SN}\d{{4,6}}{_SN}{_TOWN})?")
SPANISH = re.compile(rf"{_B}(?i:{_alt(SPANISH_WAYS)})(?!\w)(?:{_SN}(?:de|del|la|las|los|el|y)(?!\w))*(?:{_SN}{_CAP}(?:{_SN}(?:de|del|la|las|los|el|y)(?!\w))*){{1,5}},?{_SN}(?:n[°º.]{_S}?)?\d{{1,5}}[A-Za-z]?(?!\w)(?:,{_SN}\d{{4,6}}{_SN}{_TOWN})?")
GERMAN = re.compile(rf"{_B}(?:(?:{_alt(GERMAN_LEADS)}){_SN}{_CAP}(?:{_SN}{_CAP}){{0,2}}|(?:{_CAP}{_SN}){{0,3}}[{_UP}][\w-]*(?i:{_alt(GERMAN_ENDS)})|(?:{_CAP}{_SN}){{1,3}}(?i:{_alt(GERMAN_ENDS)})){_SN}\d{{1,4}}{_S}?[a-zA-Z]?(?!\w)(?:,{_SN}(?:D-|A-|CH-)?\d{{4,6}}{_SN}{_TOWN})?")

WORD = re.compile(rf"[^\W\d_]+(?:['’-][{_UP}][^\W\d_]*)*")
NAME_WORD = re.compile(rf"[{_UP}][^\W\d_]+(?:[-‐][{_UP}][^\W\d_]+)*")
SMALL_WORD = re.compile(r"[^\W\d_]{2,}(?:[-‐][^\W\d_]{2,})*")
LETTERS = re.compile(r"[^\W\d_]+")
INITIAL = re.compile(rf"[{_UP}]\.")
GAP = re.compile(_SN)
COMMA = re.compile(rf",{_SN}")
_TITLE = rf"[{_UP}][a-zà-öø-ÿ]{{2,}}(?:[-‐'’][{_UP}][a-zà-öø-ÿ]+)*"
CAPITALS = re.compile(rf"(?<![\w./@#`:-])({_TITLE})[ \t ]({_TITLE})(?![\w@(`]|[./:][\w/])(?![ \t ][{_UP}][^\W\d_]+)")


def lower_same(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


class NameModel:
    """Letter trigrams of name words against those of other capitalised words (naive Bayes with smoothing)."""

    def __init__(self, lexicon: dict[str, str], other: list[str], counted: list[tuple[bool, str, int]] | None = None):
        """counted: (of a given name, trigram, count) over all tokens of a lexicon that is larger than ``lexicon``."""
        self.lexicon = {k.lower(): v for k, v in lexicon.items()}
        names = list(self.lexicon)
        rest = sorted({w.lower() for w in other} - set(names))
        self.weights: dict[str, float] = {}
        kinds: dict[str, Counter] = {"given": Counter(), "family": Counter()}
        for given, g, k in counted or [(part == "given", g, 1) for w, part in self.lexicon.items() for g in self.grams(w)]:
            kinds["given" if given else "family"][g] += k
        pos, neg = kinds["given"] + kinds["family"], Counter(g for w in rest for g in self.grams(w))
        n_pos, n_neg, v = sum(pos.values()), sum(neg.values()), len(pos.keys() | neg.keys()) + 1
        for g in pos.keys() | neg.keys():
            self.weights[g] = math.log((pos[g] + 0.3) / (n_pos + 0.3 * v)) - math.log((neg[g] + 0.3) / (n_neg + 0.3 * v))
        self.unseen = math.log((0.3 / (n_pos + 0.3 * v)) / (0.3 / (n_neg + 0.3 * v))) - 1.0
        self.rest = frozenset(rest)
        n = {k: sum(c.values()) for k, c in kinds.items()}
        self.family_weights = {
            g: math.log((kinds["family"][g] + 0.3) / (n["family"] + 0.3 * v)) - math.log((kinds["given"][g] + 0.3) / (n["given"] + 0.3 * v)) for g in kinds["given"].keys() | kinds["family"].keys()
        }
        self._known: dict[str, float] = {}
        self.more: dict[str, str] = {}  # tokens of a larger lexicon that the text at hand holds

    @staticmethod
    def grams(w: str) -> list[str]:
        p = f"^{w}$"
        return [p[i : i + 3] for i in range(len(p) - 2)]

    def score(self, word: str) -> float:
        """Mean log odds per trigram; the lexicon's words are certain."""
        w = word.lower()
        if w in self.more:
            return 9.0
        s = self._known.get(w)
        if s is None:
            if w in self.lexicon:
                s = 9.0
            else:
                parts = re.split("[-‐]", w)
                if len(parts) > 1:
                    scores = list(map(self.score, parts))
                    s = 9.0 if max(scores) >= 9 and min(scores) > -1 else min(scores)
                elif w in self.rest:
                    s = -9.0
                elif len(w) < 4:
                    s = -9.0
                else:
                    g = self.grams(w)
                    s = sum(self.weights.get(x, self.unseen) for x in g) / len(g)
            if len(self._known) > 500_000:
                self._known.clear()
            self._known[w] = s
        return s

    def family_like(self, word: str) -> bool:
        """Does the word look more like the lexicon's family names than its given names?"""
        part = self.part(word)
        return part == "family" if part else sum(self.family_weights.get(g, 0.0) for g in self.grams(word.lower())) > 0

    def part(self, word: str) -> str | None:
        w = re.split("[-‐]", word.lower())
        return self.lexicon.get(w[-1]) or self.lexicon.get(w[0]) or self.more.get(w[-1]) or self.more.get(w[0])


#: Least score of a word beside a certain name, behind a cue, and on its own.
BESIDE, CUED, ALONE = -0.3, 0.6, 1.2
#: Least score and mean of two capitalised words without a certain name or a cue.
PAIRED, PAIR_MEAN = -1.5, -0.9
#: Least score of an unknown given name behind a family name and a comma.
BEHIND_COMMA = 0.3


class Finder:
    """Finds cases in one text; pure Python over anchors, so that text without anchors costs one automaton pass."""

    def __init__(self, lexicon: dict[str, str], other: list[str], counted: list[tuple[bool, str, int]] | None = None):
        self.names = NameModel(lexicon, other, counted)
        a = ahocorasick.Automaton()
        anchors: dict[str, set[str]] = {}
        for kind, words in (("at", AT_MARKS), ("id", ID_CUES), ("box", BOXES), ("name", NAME_CUES), ("lex", self.names.lexicon), ("title", TITLES)):
            for w in words:
                if w:
                    anchors.setdefault(w, set()).add(kind)
        for kind, words in (("en", STREET_WORDS), ("fr", FRENCH_WAYS), ("es", SPANISH_WAYS), ("code", STREET_WORDS_WITH_CODE), ("it", ITALIAN_WAYS), ("de", GERMAN_ENDS), ("nl", DUTCH_ENDS), ("lead", [w.lower() for w in GERMAN_LEADS])):
            for w in words:
                anchors.setdefault(w, set()).add(kind)
        for w, kinds in anchors.items():
            a.add_word(w, (len(w), tuple(sorted(kinds))))
        a.make_automaton()
        self.automaton = a

    # -- emails ---------------------------------------------------------------------------------------------------
    def email(self, text: str, low: str, at: int, end: int) -> tuple[int, int] | None:
        mark = low[at:end]
        left_end, right = at, end
        while left_end > 0 and text[left_end - 1] in "  " and at - left_end < 2:
            left_end -= 1
        spaced = left_end != at
        m = EMAIL_LEFT.search(text, max(0, left_end - 66), left_end)
        if not m:
            return None
        while right < len(text) and text[right] in "  " and right - end < 2:
            right += 1
        if mark == "@" and (spaced != (right != end)):
            return None  # a blank on one side only: a mention or a decorator
        d = EMAIL_RIGHT.match(text, right)
        if not d:
            return None
        domain = d.group()
        if mark == " at " and not re.search(r"dot", domain, re.I):
            return None
        end = d.end()
        last = LAST_LABEL.search(domain)
        if not last:
            return None
        start = m.start()
        if text[start:left_end].lower().startswith("mailto:"):
            start += 7
        if start and (text[start - 1] in "/@" or low[max(0, start - 3) : start] == "://"):
            return None
        if end < len(text) and text[end] == ":" and end + 1 < len(text) and not text[end + 1].isspace() and not text[end + 1] in "\"'":
            return None  # a repository remote: host:path
        if end < len(text) and text[end] == "/" and mark == "@" and low[start:left_end] == "git":
            return None
        while text[start] in "'&%.-+" and start < left_end - 1:
            start += 1
        return start, end

    # -- numbers --------------------------------------------------------------------------------------------------
    def numbers(self, text: str, low: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
        for m in NUMBER.finditer(text):
            s, e = m.span()
            before = text[s - 1] if s else " "
            if before.isalnum() or before in "_./#@:$€£%-~^" and not (before == ":" or before in "/" and s > 1 and text[s - 2] == " "):
                continue
            after = text[e] if e < len(text) else " "
            raw = m.group()
            hit = None
            other = OTHER_NUMBER.search(low, max(0, s - 24), s)
            for pattern, kind in ((GROUPS_OF_FOUR, "id_number"), (SSN_DASHED, "id_number"), (NANP, "phone"), (INTERNATIONAL, "phone"), (NATIONAL, "phone")):
                p = pattern.match(raw)
                if other and pattern in (GROUPS_OF_FOUR, NATIONAL):
                    continue
                if p and self._closed(text, s + p.end()) and 7 <= sum(map(str.isdigit, p.group())) <= 15:
                    if pattern is INTERNATIONAL and raw.startswith("00") and sum(map(str.isdigit, p.group())) < 11:
                        continue
                    hit = (s, s + p.end(), kind)
                    break
            if not hit and PHONE_CUE.search(low, max(0, s - 30), s):
                p = LOCAL.match(raw)
                if p and self._closed(text, s + p.end()) and 7 <= sum(map(str.isdigit, p.group())) <= 13 and not re.match(r"\d{4}-\d\d-\d\d", raw):
                    hit = (s, s + p.end(), "phone")
            if not hit:
                continue
            if hit[2] == "phone":
                x = EXTENSION.match(text, hit[1])
                if x:
                    hit = (hit[0], x.end(), "phone")
            yield hit
        for start, end in cues:
            g = CUE_GAP.match(text, end)
            p = g.end() if g else end
            for pattern in (NI, LICENCE, PASSPORT, SSN, GROUPS_OF_FOUR, ANY_ID):
                m = pattern.match(text, p)
                if m and self._closed(text, m.end()) and sum(map(str.isdigit, m.group())) >= 5:
                    yield m.start(), m.end(), "id_number"
                    break

    @staticmethod
    def _closed(text: str, e: int) -> bool:
        """No digit, letter or joined number goes on behind the end."""
        if e >= len(text):
            return True
        c = text[e]
        if c.isalnum() or c == "_":
            return False
        if c in "-./:," and e + 1 < len(text) and text[e + 1].isdigit():
            return False
        return not (c == " " and re.match(r" \d{2,}(?![\w-])", text[e : e + 8]) and not re.match(r" \d+\s+[^\W\d]", text[e : e + 12]))

    # -- addresses ------------------------------------------------------------------------------------------------
    def address(self, text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
        if kind == "box":
            m = BOX.match(text, start)
            return m.span() if m else None
        if kind == "es":
            m = SPANISH.match(text, start)
            return m.span() if m else None
        if kind == "it":
            m = ITALIAN.match(text, start)
            return m.span() if m else None
        if kind in ("en", "fr", "code"):
            pattern = {"en": ENGLISH, "fr": FRENCH, "code": CODED}[kind]
            # The house number stands a few words before the street's word.
            for m in re.finditer(r"\d{1,5}", text[max(0, start - 64) : start]):
                p = max(0, start - 64) + m.start()
                if p and (text[p - 1].isalnum() or text[p - 1] in "_-./#"):
                    continue
                x = pattern.match(text, p)
                if x and x.end() >= end:
                    e = x.end()
                    whole = re.search(r"(\w+)\.\Z", x.group())
                    if whole and (whole[1].lower() not in ABBREVIATIONS or re.match(r"\s*(?:\Z|\n|[^\sa-z,;#)|])", text[e : e + 4])):
                        e -= 1  # the full stop of the sentence, not of an abbreviation
                    return x.start(), e
            return None
        m = re.match(rf"{_SN}\d{{1,4}}", text[end : end + 10]) if kind == "de" else None
        if kind == "de" and not m:
            return None
        if kind == "nl":
            p = start
            while p and (text[p - 1].isalnum() or text[p - 1] == "-"):
                p -= 1
            x = DUTCH.match(text, p)
            return x.span() if x and x.end() >= end else None
        low = max(0, start - 48) if kind == "de" else start
        for p in range(low, start + 1):
            if (p == 0 or not (text[p - 1].isalnum() or text[p - 1] in "_-")) and text[p : p + 1].isupper():
                x = GERMAN.match(text, p)
                if x and x.end() >= end:
                    if kind == "lead" and not re.search(r"\d\w?,\s+\S*\d{4,6}\s", x.group()):
                        return None
                    return x.span()
        return None

    # -- names ----------------------------------------------------------------------------------------------------
    def _word_at(self, text: str, p: int, small: bool = False) -> re.Match | None:
        m = (SMALL_WORD if small else NAME_WORD).match(text, p)
        if not m or (m.end() < len(text) and (text[m.end()].isdigit() or text[m.end()] == "_")):
            return None
        return m

    def _likely(self, word: str, least: float) -> bool:
        return self.names.score(word) >= least

    def name(self, text: str, p: int, least: float, small: bool = False) -> tuple[int, int] | None:
        """Name whose first word or initial stands at ``p``; at least one word must reach ``least`` or be known."""
        start, end, sure, words = p, p, False, 0
        q = p
        parts: list[str] = []
        while words < 5:
            i = INITIAL.match(text, q)
            if i and (not words or GAP.match(text, i.end())) or (i and words and not GAP.match(text, i.end())):
                if not GAP.match(text, i.end()):
                    break
                q = i.end()
                words += 1
                parts.append("i")
            else:
                m = self._word_at(text, q, small)
                if not m:
                    break
                need = (CUED if small else BESIDE) if sure else least
                s = self.names.score(m.group())
                nxt = None
                if s < need:
                    # An uncertain first word counts if a certain one follows it.
                    g = GAP.match(text, m.end()) if not sure else None
                    while g and (j := INITIAL.match(text, g.end())):
                        g = GAP.match(text, j.end())
                    nxt = self._word_at(text, g.end(), small) if g else None
                    if not (nxt and s >= (CUED if small else BESIDE) and self.names.score(nxt.group()) >= 5):
                        break
                sure = sure or s >= need
                q = end = m.end()
                words += 1
                parts.append(self.names.part(m.group()) or "?")
                if nxt is not None:
                    sure = True
            g = GAP.match(text, q)
            if not g:
                break
            q = g.end()
        if end == p or not sure:
            return None
        # Family name, given name
        if len(parts) == 1 and parts[0] != "given":
            c = COMMA.match(text, end)
            m = self._word_at(text, c.end(), small) if c else None
            if m and (self.names.part(m.group()) == "given" or (self.names.part(m.group()) is None and self._likely(m.group(), BEHIND_COMMA) and parts[0] == "family")):
                end = m.end()
                g = GAP.match(text, end)
                i = INITIAL.match(text, g.end()) if g else None
                if i and i.end() < len(text) and text[i.end()] in " ,;|<\n":
                    end = i.end()
        return start, end

    def names_at(self, text: str, low: str, lex: list[tuple[int, int]], cues: list[tuple[int, int, str]], titles: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
        tried: set[int] = set()
        covered = 0
        spans: list[tuple[int, int]] = []
        places: list[tuple[int, float, bool]] = []
        for s, e in titles:
            if s and (text[s - 1].isalnum() or text[s - 1] in "_@."):
                continue
            q = e + 1 if e < len(text) and text[e] == "." else e
            g = GAP.match(text, q)
            if g and text[s].isupper() and (q != e or low[s:e] in ("herr", "frau", "miss", "monsieur", "madame", "señor", "señora", "sir", "professor", "mme", "mlle", "mr", "mrs", "ms", "dr")):
                places.append((g.end(), -2.0, True))
        for s, e, cue in cues:
            if cue[0].isalpha() and s and (text[s - 1].isalnum() or text[s - 1] == "_"):
                continue
            q = e
            while q < len(text) and q - e < 4 and text[q] in " \t  \n\"'“«":
                q += 1
            if q < len(text) and text[q].isupper():
                places.append((q, ALONE if cue in WEAK_CUES else CUED, False))
        for s, e in lex:
            small = not text[s].isupper()
            if small and (text[e : e + 1] in ("@", "+", "_") or s and text[s - 1] in "+@"):
                continue
            places.append((self._leftmost(text, s, small), 5.0, False))
        for p, least, titled in sorted(places):
            if p >= len(text) or p < covered or (p, least) in tried:
                continue
            tried.add((p, least))
            if p and (text[p - 1].isalnum() or text[p - 1] in "_`@\\" or text[p - 1] in "/." and not text[p - 2 : p - 1].isspace() and p > 1):
                continue
            found = self.name(text, p, least, not text[p].isupper())
            if not found and least == 5.0:
                found = self.name(text, p, CUED, not text[p].isupper())  # an unknown family name before a comma
            if not found:
                continue
            s, e = found
            if not titled and self._module(text, low, s, e):
                continue
            covered = e
            spans.append((s, e))
            yield s, e, "name"
        # Two capitalised words that are no common words of the corpus stand for a person if the model doesn't object.
        spans = sorted(spans + lex)
        for m in CAPITALS.finditer(text):
            i = bisect_left(spans, m.span())
            if (i and spans[i - 1][1] > m.start()) or (i < len(spans) and spans[i][0] < m.end()):
                continue
            scores = [self.names.score(w) for w in m.groups()]
            if min(scores) >= PAIRED and sum(scores) >= 2 * PAIR_MEAN:
                yield *m.span(), "name"

    def _leftmost(self, text: str, s: int, small: bool = False) -> int:
        """Start of the run of initials and likely name words that ends with the word at ``s``."""
        p = s
        # A hyphenated word begins with its first part.
        while p > 1 and text[p - 1] in "-‐" and text[p - 2].isalpha():
            q = p - 1
            while q > 0 and text[q - 1].isalpha():
                q -= 1
            if not small and not text[q].isupper():
                break
            p = q
        first = "" if small else f"[{_UP}]"
        comma = re.search(rf"(?<![\w'’`/.@-])({first}[^\W\d_]+(?:[-‐]{first}[^\W\d_]+)*),{_SN}\Z", text[max(0, p - 40) : p])
        if comma and self.names.score(comma.group(1)) >= (ALONE if small else CUED) and self.names.family_like(comma.group(1)) and not self.names.family_like(self._word_at(text, p, small).group() if self._word_at(text, p, small) else "x"):
            return max(0, p - 40) + comma.start()
        while True:
            m = re.search(rf"(?:(?<![^\W_])[{_UP}]\.|(?<![\w'’`/.@-]){first}[^\W\d_]+(?:[-‐]{first}[^\W\d_]+)*){_SN}\Z", text[max(0, p - 40) : p])
            if not m:
                return p
            word = m.group().strip()
            if small and word[0].isupper() and not INITIAL.fullmatch(word):
                return p  # a name in small letters begins where the capitals end
            if not (INITIAL.fullmatch(word) or self.names.score(word) >= (CUED if small else BESIDE)):
                return p
            p = max(0, p - 40) + m.start()

    def _module(self, text: str, low: str, s: int, e: int) -> bool:
        """A name that stands for a module or is part of an identifier, a path or code."""
        after = text[e : e + 2]
        if after[:1] in ("_", "`", "(", "\\") or (after[:1] in "./:" and after[1:2].isalnum() and after[1:2] != ""):
            return True
        if s and text[s - 1] in "`_":
            return True
        if not re.search(r"\s", text[s:e]) and re.search(r"(?:^|[^\w])(?:the|our|le|la|el|der|die|das)\s{1,3}\Z", low[max(0, s - 6) : s]):
            return bool(re.match(r"\s{1,3}[a-zà-ÿ]", text[e : e + 4]))
        return False

    # -- all ------------------------------------------------------------------------------------------------------
    def find(self, text: str | None, known: list[str] | None = None) -> list[tuple[int, int, str]]:
        """Cases of a text; known: tokens (word=part) of a larger lexicon that are in the text."""
        if not text:
            return []
        low = lower_same(text)
        self.names.more = dict(k.rsplit("=", 1) for k in known or ())
        found: list[tuple[int, int, str]] = []
        lex, cues, titles, ids = [], [], [], []
        is_part = lambda p: 0 <= p < len(text) and (text[p].isalnum() or text[p] == "_")
        for last, (n, kinds) in self.automaton.iter(low):
            s, e = last + 1 - n, last + 1
            for kind in kinds:
                if kind == "at":
                    if x := self.email(text, low, s, e):
                        found.append((*x, "email"))
                    continue
                if kind == "name":
                    cues.append((s, e, low[s:e]))
                    continue
                if kind in ("de", "nl"):
                    if not is_part(e) and (x := self.address(text, s, e, kind)):
                        found.append((*x, "address"))
                    continue
                if is_part(s - 1) or is_part(e):
                    continue
                if kind == "lex":
                    lex.append((s, e))
                elif kind == "title":
                    titles.append((s, e))
                elif kind == "id":
                    ids.append((s, e))
                elif x := self.address(text, s, e, kind):
                    found.append((*x, "address"))
        if self.names.more:
            lex += [m.span() for m in LETTERS.finditer(low) if m.group() in self.names.more and m.group() not in self.names.lexicon and not is_part(m.start() - 1) and not is_part(m.end())]
            lex.sort()
        found += self.numbers(text, low, ids)
        found += [(*m.span(), "id_number") for p in (NI, LICENCE) for m in p.finditer(text)] if re.search(r"\d{2}", text) else []
        found += self.names_at(text, low, lex, cues, titles)
        return longest(found)


RANK = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}


def longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Cases without overlaps: the longer stands; of equal length the type that comes first."""
    out: list[tuple[int, int, str]] = []  # in order; what stands doesn't overlap, so only neighbours matter
    for c in sorted(set(found), key=lambda c: (c[0] - c[1], RANK[c[2]], c[0])):
        i = bisect_left(out, c)
        if (not i or out[i - 1][1] <= c[0]) and (i == len(out) or c[1] <= out[i][0]):
            out.insert(i, c)
    return out


def replace(text: str | None, cases: list[tuple[int, int, str]]) -> str | None:
    if not text or not cases:
        return text
    parts, at = [], 0
    for s, e, kind in cases:
        parts += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


def read_lexicon(df: DataFrame, token: str = "token", part: str = "name_part", limit: int = LEXICON_LIMIT) -> tuple[dict[str, str], DataFrame | None]:
    """The lexicon as a dictionary of at most about ``limit`` tokens, which is sent to every executor, and, of a larger
    one, all tokens (word, part) in lower case, which are joined to the texts."""
    rows = df.where(F.col(token).isNotNull()).groupBy(F.lower(token).alias("word")).agg(F.max(F.coalesce(part, F.lit("family"))).alias("part"))
    n = rows.count()
    few = hashed_sample(rows, ["word"], limit, n)
    return {r[0]: r[1] for r in few.orderBy("word").collect()}, None if n <= limit else rows


def gram_counts(rows: DataFrame) -> list[tuple[bool, str, int]]:
    """(of a given name, trigram, count) over all tokens of a lexicon; there are only so many trigrams of letters."""
    p = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = rows.where("length(word) > 0").select((F.col("part") == "given").alias("given"), F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(p, i, F.lit(3)))).alias("g"))
    return sorted(map(tuple, grams.groupBy("given", "g").count().collect()))


def with_known(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, text, known): the words of each text that the lexicon holds, as word=part. Words are made distinct before they
    are joined; what meets in one row are the words of one text."""
    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "texts")
    words = numbered.select("__row", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("word <> ''")
    hits = words.join(rows, "word").groupBy("__row").agg(F.collect_list(F.concat_ws("=", "word", "part")).alias("known"))
    return numbered.join(hits, "__row", "left").select("key", "text", "known")


#: A word that is in at least this share of the rows with a text (and in three) isn't taken for a name.
COMMON_SHARE = 0.005


def other_words(df: DataFrame, text: str, lexicon: dict[str, str], all_words: DataFrame | None = None) -> list[str]:
    """Words of all rows, labelled as no names for the classifier.

    They are the words in lower case or at the beginning of sentences that are in many of the rows. All texts are read and
    counted by the executors, a batch at a time; only the common words come to the driver: as a text has few words, they are
    few, however many texts there are. Words of the lexicon are none of them, also of one that isn't broadcast as a whole.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            found = Counter(w for t in texts for w in common_candidates(t))
            found[""] = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["w", "n"])

    texts = df.select(F.col(text).alias("t")).where("length(t) > 0")
    counts = cut(texts.mapInArrow(words, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "words")
    least = counts.where("w = ''").agg(F.greatest(F.lit(3.0), F.max("n") * COMMON_SHARE).alias("n")).scalar()
    often = counts.where((F.col("n") >= least) & (F.col("w") != "")).select("w")
    if all_words is not None:
        often = often.join(all_words.select(F.col("word").alias("w")), "w", "left_anti")
    return sorted({r[0] for r in often.collect()} - {k.lower() for k in lexicon})


def common_candidates(text: str) -> set[str]:
    return set(OTHER_SMALL.findall(text)) | {w.lower() for w in OTHER_GREAT.findall(text)}


def common_words(texts: list[str], lexicon: dict[str, str]) -> list[str]:
    """The same over a list of texts."""
    rows = Counter(w for t in texts for w in common_candidates(t))
    often = {w for w, k in rows.items() if k >= max(3, len(texts) * COMMON_SHARE)}
    return sorted(often - {k.lower() for k in lexicon})


OTHER_SMALL = re.compile(r"(?<![\w./@+=-])([^\W\d_A-ZÀ-ÖØ-Þ]{3,20})(?![\w@-])")
OTHER_GREAT = re.compile(rf"(?:^|[.!?;] |\n)([{_UP}][^\W\d_]{{1,20}})(?![\w@-])")


_finders: dict[str, Finder] = {}


def find_cases(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, start_char, end_char, pii_type); offsets count Unicode code points, the end is exclusive.

    Defined cases: null and empty texts have no cases; an empty lexicon leaves cues and the classifier; repeated rows
    give repeated cases; whole texts are read, however long.
    """
    return _run(df, key, text, lexicon, masked=False)


def mask(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, text): each case replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME], the rest unchanged."""
    return _run(df, key, text, lexicon, masked=True)


def _run(df: DataFrame, key: str, text: str, lexicon: DataFrame, masked: bool) -> DataFrame:
    words, all_words = read_lexicon(lexicon)
    other = other_words(df, text, words, all_words)
    counted = None if all_words is None else gram_counts(all_words)
    digest = hashlib.sha256(repr((sorted(words.items()), other, counted)).encode()).hexdigest()
    shared, joined = df.sparkSession.sparkContext.broadcast((words, other, counted)), all_words is not None
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _finders:  # one finder per worker and lexicon
            _finders.clear()
            _finders[digest] = Finder(*shared.value)
        find = _finders[digest].find
        for b in batches:
            texts = b.column(1).to_pylist()
            cases = [find(t) for t in texts] if not joined else [find(t, k) for t, k in zip(texts, b.column(2).to_pylist())]
            if masked:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([replace(t, c) for t, c in zip(texts, cases)], pa.string())], ["key", "text"])
                continue
            at = [i for i, c in enumerate(cases) for _ in c]
            flat = [c for cs in cases for c in cs]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array([c[0] for c in flat], pa.int32()), pa.array([c[1] for c in flat], pa.int32()), pa.array([c[2] for c in flat], pa.string())],
                ["key", "start_char", "end_char", "pii_type"],
            )

    schema = f"key {kind}, text string" if masked else f"key {kind}, start_char int, end_char int, pii_type string"
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    docs = with_known(docs, all_words) if joined else docs
    return docs.mapInArrow(run, schema).withColumnRenamed("key", key)
