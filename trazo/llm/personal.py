"""Problem 2: personal information inside free text.

Method: anchor expansion. One Aho-Corasick pass over the repaired, lower-cased text finds
anchors: at-signs and their spellings, digits, words of numbers, schemes of streets, titles,
given names and the cues that announce a name. A deterministic parser for the anchor's kind
expands it to the left and right, over no more than NEAR characters, and validates what it
found. Only initials and two capitalised words in a row, which no fixed word announces, are
found by patterns; the time a text takes grows with its length and no faster.
Kinds are parsed in the order e-mail, account, identity number, phone, address, name; what an
earlier kind holds is closed to later ones. Account numbers (IBAN, payment cards) are replaced
too, but aren't among the kinds that ``find`` is asked for by default.

The text is repaired first (see ``lookalikes``), with a map back to the given characters, so
full-width digits or an invisible character inside a number hide nothing and the rest of
the text keeps its own characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trazo.llm.lookalikes import fold

KINDS = ("email", "phone", "id_number", "address", "name")
#: Characters to either side of an anchor that belong to its surroundings; no local part of an address is longer.
NEAR = 100
#: Given names are sent to every task; a larger table is refused rather than broadcast.
MOST_GIVEN_NAMES = 200_000

# Cues and word lists.
AT_SIGNS = ("@", "arroba", "[at]", "(at)", "{at}", "<at>")
STREETS = (
    "c/", "calle", "cl.", "avenida", "avda", "avd.", "av.", "plaza", "pza", "plz", "pl.", "paseo", "p.º", "po.", "travesía", "travesia", "trv.", "trav.",
    "camino", "cno.", "carretera", "ctra", "ronda", "glorieta", "gta.", "callejón", "callejon", "pasaje", "pje.", "rambla", "urbanización",
    "urbanizacion", "urb.", "cuesta", "costanilla", "alameda", "barrio", "vía", "bulevar", "polígono", "parque",
)
TITLES = (
    "sr", "sra", "srta", "sres", "don", "doña", "d.", "d.ª", "dña", "dr", "dra", "prof", "profa", "profesor", "profesora", "señor", "señora",
    "señorita", "doctor", "doctora", "maestro", "maestra", "tutor", "tutora", "lic", "ing", "mr", "mrs", "ms", "mme", "herr", "frau",
)
# What announces a person: introductions, signatures, requests to tell or warn somebody, talk with or about somebody, form fields.
NAME_CUES = (
    "me llamo", "mi nombre es", "se llama", "soy", "firmado", "firma", "fdo", "atentamente", "mi tutora es", "mi tutor es", "dile a", "díselo a",
    "apunta a", "avisa a", "es de", "conmigo", "habla con", "hablé con", "pregunta por", "de parte de", "a nombre de", "ha venido",
    "nombre:", "alumno:", "alumna:", "paciente:", "madre:", "padre:",
)
# What a person does to or for the writer, or just does.
NAME_AFTERCUES = ("me ayudó", "me dijo", "me enseñó", "me escribió", "me llamó", "me dio", "me contó", "me explicó", "trajo", "vino", "llegó", "ha venido", "llamó", "dijo")
NOT_NAMES = frozenset(
    """semana santa sala año nuevo navidad reyes magos feria tortuga veloz lunes martes miércoles miercoles jueves viernes sábado sabado domingo
    enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre aula colegio escuela instituto biblioteca museo parque
    dile díselo apunta firmado firma fdo llamo llama llámale habla nombre avisa escribe escríbele respóndele copia ficha hoja lo hoy ayer mañana ahora luego entonces después despues antes nunca siempre también tampoco quiero tengo dice creo parece seguro todavía
    nadie nuestro nuestra vuestro gracias adiós hola buenos buenas días tardes noches profe exp tel tfno móvil movil dni nif nie correo contacto
    domicilio vivo mandad manda escríbeme escribeme llámame llamame respondan contesta identidad pregunta cuesta cita del los las una uno unos unas
    que quién quien qué cómo cuando donde porque pero aunque mientras para por con sin sobre entre hasta desde hacia según segun bajo ante tras
    soy como este esta estos estas ese esa esos esas aquel aquella mi tu su mis tus sus yo tú él ella nosotros ellos ellas me te se nos les lo le ya muy más
    mas menos bien mal sí no ni quiénes cuál aquí allí ahí está están es son fue era hay tiene tienen ha han he hemos ser estar
    verde roja rojo azul blanca negra amarilla ventura feliz padre madre hermano hermana señor señora doña don sra sr the and our was near""".split()
)

_NAME_ANCHORS = frozenset(("given", "title", "cue", "after"))
_initial = re.compile(r"(?<![^\W_])[^\W\d_]\.\s?[^\W\d_]{3}")
_two_capitals = re.compile(r"[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]{2,}(?: (?:de|del|de la))? [A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]{3}")
_word = re.compile(r"[^\W\d_ªº]+(?:['’-][^\W\d_ªº]+)*")
# e-mail
_local_left = re.compile(r"[\w.+%'\-]+$")
_DOT = r"(?:\.|\s?\(?\[?\b(?:punto|dot)\b\]?\)?\s?)"
_domain = re.compile(rf"[\s<]*([a-z0-9áéíóúñ\-]+(?:\s?{_DOT}\s?[a-z0-9áéíóúñ\-]+)*)", re.I)
_domain_tight = re.compile(rf"\s*([a-z0-9áéíóúñ\-]+(?:(?:\.|\s?[\[(]?(?:punto|dot)[\])]?\s)[a-z0-9áéíóúñ\-]+)+)", re.I)
_brackets = re.compile(r"\s*[(\[{<]?\s*$"), re.compile(r"\s*[)\]}>]?\s*")
# numbers
_id = re.compile(
    r"(?<![\w])(?:"
    r"(?P<dni>\d{2}[.\s]?\d{3}[.\s]?\d{3}\s?[-–]?\s?(?P<dl>[A-Za-z]))(?![\w])"
    r"|(?P<nie>[XYZxyz]\s?[-–]?\s?\d(?:\d{6}|\.?\d{3}\.?\d{3})\s?[-–]?\s?(?P<nl>[A-Za-z]))(?![\w])"
    r"|(?P<nss>\d{2}\s?[/\-– ]\s?\d{7,8}\s?[/\-– ]\s?\d{2})(?![\d/\-])"
    r"|(?P<nss12>\d{12})(?!\w)"
    r")"
)
_phone = re.compile(
    r"(?<![\w+])(?:"
    r"(?P<es>(?:(?:\(\s?(?:\+|00)\s?34\s?\)|(?:\+|00)\s?34)[\s.\-]?)?(?P<rest>[6-9]\d{8}|[6-9]\d{2}(?P<s>[\s.\-])\d{3}(?P=s)\d{3}|[6-9]\d{2}(?P<s2>[\s.\-])\d{2}(?P=s2)\d{2}(?P=s2)\d{2}"
    r"|[6-9]\d(?P<s3>[\s.\-])\d{3}(?P=s3)\d{2}(?P=s3)\d{2}|[6-9]\d(?P<s4>[\s.\-])\d{2}(?P=s4)\d{2}(?P=s4)\d{2}(?P=s4)\d|[6-9]\d{2}(?P<s5>[\s.\-])\d{6}|[6-9]\d{2}[\s]\d{2}-\d{2}-\d{2}))"
    r"|(?P<intl>(?:\(\s?(?:\+|00)\s?\d{1,3}\s?\)|\+\s?\d{1,3}|00\s?[1-9]\d{0,2}(?=[\s.\-(]))(?:[\s.\-]?\(?\d{2,4}\)?){2,5})"
    r")(?![\w]|[.,]\d)"
)
# numbers in words: fixed values, digits by word
_UNITS = dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")) | {"un": "1", "una": "1"}
_TEENS = dict(zip("diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve".split(), map(str, range(10, 30))))
_TENS = dict(zip("treinta cuarenta cincuenta sesenta setenta ochenta noventa".split(), "3456789"))
_HUNDREDS = dict(zip("cien ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split(), "1123456789"))
_number_words = sorted({*_UNITS, *_TEENS, *_TENS, *_HUNDREDS, *(w.translate(str.maketrans("éó", "eo")) for w in _TEENS)}, key=len, reverse=True)
_spelled = re.compile(rf"(?<!\w)(?:{'|'.join(_number_words)})(?:[\s,\-]+(?:y\s+)?(?:{'|'.join(_number_words)}))+(?!\w)", re.I)
_spelled_left = re.compile(rf"(?<!\w)((?:{'|'.join(_number_words)})[\s,\-]+(?:y\s+)?)$", re.I)
_iban = re.compile(r"(?<![\w])[A-Za-z]{2}\d{2}(?:\s?[A-Za-z0-9]){11,30}")
_card = re.compile(r"(?<![\w+/\-])[2-6]\d{3}(?P<c>[ \-]?)\d{4,6}(?P=c)\d{4,5}(?:(?P=c)\d{1,4})?(?![\w/\-])")
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value: control letter by remainder
_id_cue = re.compile(r"(?<!\w)(?:dni|nif|nie|documento|identidad|identificación|identificacion|carné|carne|carnet|pasaporte|afiliación)(?!\w)")
# addresses
_street_rest = re.compile(
    r"\.?\s*"
    r"(?P<name>(?:(?:de|del|la|las|los|el|l'|d'|san|santa|y)\s+){0,4}[^\W\d_][\w'’\-]*\.?(?:\s+[^\W\d_][\w'’\-]*){0,4}?)"
    r"(?P<sep>\s*,?\s*(?:n\s?[.º°]{1,2}\s?[ºo]?\.?|núm(?:ero)?\.?|num(?:ero)?\.?|nº|n°|\#)\s*|\s*,\s*|\s+)"
    r"(?P<no>\d{1,4}(?![\d/:])(?:\s?bis\b)?|s/n\b)",
    re.I,
)
_floor = re.compile(
    r"\s*,?\s*(?:-\s*)?(?:pis(?:o|ó)\.?\s*\d{1,2}(?:\s?\.?\s?[ºª°])?|\d{1,2}\s?\.?\s?[ºª°]\.?\s*(?:(?:izda|izq|izqda|dcha|dch|derecha|izquierda|int|ext|centro)\b\.?|[a-z](?![\w]))?"
    r"|baj[oa]s?\b(?:\s+(?:izda|izq|dcha|derecha|izquierda)\b\.?|\s+[a-z](?![\w]))?|ático\b|entresuelo\b|esc(?:alera)?\.?\s*\w{1,2}(?![\w])|portal\s*\w{1,2}(?![\w])|bloque\s*\w{1,2}(?![\w])|bl\.\s*\w{1,2}"
    r"|(?:puerta|pta\.?)\s*\w{1,2}(?![\w])|(?:izda|izq|izqda|dcha|derecha|izquierda)\b\.?|\d{1,2}\s*(?:izda|izq|dcha)\b\.?)",
    re.I,
)
_post = re.compile(r"\s*,?\s*(?:\(?\s*)?(?:c\.?\s?p\.?:?\s*)?(?<!\d)\d{5}(?!\d)", re.I)
_town_in = re.compile(r"\s*,?\s*\(\s*[^\W\d_][^()\d@]{1,40}\)")
_town = re.compile(r"\s*,?\s+(?:de\s+)?[A-ZÁÉÍÓÚÑ][\w'’\-]+")
_town_low = re.compile(r"\s*,?\s+[^\W\d_][\w'’\-]+")


def bare(word: str) -> str:
    """Lower case without accents; the tilde of the n stays."""
    if word.isascii():
        return word.lower()
    out = unicodedata.normalize("NFD", word.lower().replace("ñ", "\x00"))
    return "".join(c for c in out if not unicodedata.combining(c)).replace("\x00", "ñ")


class Finder:
    """Finds and replaces personal information.

    given: given names, of any case. common: words that are never part of a name, such as
    the terms of a lexicon; ``lower`` is applied to both.
    """

    def __init__(self, given: Iterable[str], common: Iterable[str] = ()):
        import ahocorasick

        self.given = {bare(g) for g in given if g and len(g) > 1}
        self.common = {w.lower() for w in common if w}
        self.common_bare = {bare(w) for w in self.common}
        auto = ahocorasick.Automaton()
        for kind, words in (("mail", AT_SIGNS), ("street", STREETS), ("title", TITLES), ("cue", NAME_CUES), ("after", NAME_AFTERCUES), ("digit", "0123456789"), ("spelled", {*_UNITS, *_TENS, *_HUNDREDS} - {"un", "una", "uno"})):
            for w in words:
                kinds = auto.get(w, ())
                auto.add_word(w, (*kinds, (kind, len(w))))
        for g in self.given | {x.lower() for x in given if x}:
            kinds = auto.get(g, ())
            auto.add_word(g, (*kinds, ("given", len(g))))
        auto.make_automaton()
        self.auto = auto

    # -- anchors ---------------------------------------------------------------------
    def anchors(self, low: str) -> dict[str, list[tuple[int, int]]]:
        """Places of the anchors by kind; words count only as whole words."""
        found: dict[str, list[tuple[int, int]]] = {}
        n = len(low)
        for end, kinds in self.auto.iter(low):
            for kind, length in kinds:
                a, b = end - length + 1, end + 1
                if kind == "digit":
                    found.setdefault(kind, []).append((a, b))
                    continue
                if low[a].isalnum() and a and low[a - 1].isalnum():
                    continue
                if low[b - 1].isalnum() and b < n and low[b].isalnum():
                    if not (kind == "street" and low[b - 1] == "/"):
                        continue
                found.setdefault(kind, []).append((a, b))
        return found

    # -- one kind each ---------------------------------------------------------------
    def _take(self, kind: str, a: int, b: int) -> None:
        self._out.append((kind, a, b))
        self._closed[a:b] = b"\x01" * (b - a)

    def emails(self, text: str, at: list[tuple[int, int]]) -> None:
        for a, b in at:
            if self._closed[a]:
                continue
            base = max(0, a - NEAR)
            left = text[base:a]
            spelled = text[a:b] != "@"
            cut = _brackets[0].search(left).start()
            m = _local_left.search(left[:cut].rstrip())
            if not m:
                continue
            start, local = base + m.start(), m[0]
            if start == base > 0:
                continue  # longer than any local part
            while local and not local[0].isalnum():
                start, local = start + 1, local[1:]
            if not local or not local[-1].isalnum():
                continue
            right = _brackets[1].match(text, b).end()
            tight = _domain_tight.match(text, right)
            if not tight:
                continue
            if not spelled and text[b : b + 1].isspace() and start and cut == a and "." not in tight[1]:
                continue
            labels = re.split(r"\.|\s?[\[(]?(?:punto|dot)[\])]?\s", tight[1], flags=re.I)
            if len(labels) < 2 or any(not x for x in labels):
                continue
            while len(labels) >= 2 and not (labels[-1].isalpha() and len(labels[-1]) >= 2):
                labels.pop()
            if len(labels) < 2:
                continue
            self._take("email", start, tight.end())

    def accounts(self, text: str, runs: list[int]) -> None:
        """IBANs and payment cards, from the first digit of each run; only those whose check digits are right."""
        pos = 0
        for d in runs:
            if d < pos or self._closed[d]:
                continue
            if d >= 2 and text[d - 2 : d].isalpha():
                end = _iban_end(text, d - 2)
            else:
                m = _card.match(text, d, d + NEAR)
                end = m.end() if m and _luhn(m[0]) else 0
            if end:
                self._take("account", d - 2 if text[d - 1 : d].isalpha() else d, end)
                pos = end

    def numbers(self, text: str, low: str, runs: list[int]) -> None:
        """Identity numbers, from the first digit of each run; the letter of a foreigner's number stands up to four places before it."""
        pos = 0
        for d in runs:
            if d < pos:
                continue
            for s in range(max(pos, d - 4), d + 1):
                if s < d and text[s] not in "XYZxyz" or not (m := _id.match(text, s, d + NEAR)):
                    continue
                pos = m.end()
                if not self._closed[m.start()] and self._valid(m, low):
                    self._take("id_number", m.start(), m.end())
                break

    @staticmethod
    def _valid(m: re.Match, low: str) -> bool:
        """The control letter is right, or a cue stands in front; the same for twelve digits without separators and their control number."""
        digits = "".join(c for c in m[0] if c.isdigit())
        if letter := m["dl"] or m["nl"]:
            lead = {"Y": "1", "Z": "2"}.get(m[0][0].upper(), "")
            right = _DNI_LETTERS[int(lead + digits) % 23] == letter.upper()
        elif m["nss12"]:
            whole = int(digits[:10]) if int(digits[2:10]) >= 10**7 else int(digits[:2] + digits[3:10])
            right = whole % 97 == int(digits[10:]) and int(digits[:2]) > 0
        else:
            right = True
        return right or _id_cue.search(low, max(0, m.start() - 40), m.start()) is not None

    def phones(self, text: str, runs: list[int]) -> None:
        """Phone numbers, from the first digit of each run; a plus sign or bracket stands up to four places before it."""
        pos = 0
        for d in runs:
            if d < pos:
                continue
            for s in range(max(pos, d - 4), d + 1):
                if s < d and text[s] not in "(+" or not (m := _phone.match(text, s, d + NEAR)):
                    continue
                if self._closed[m.start()] or self._closed[m.end() - 1] or m["intl"] and not 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    continue
                pos = m.end()
                self._take("phone", m.start(), pos)
                break

    def spelled(self, low: str, at: list[tuple[int, int]]) -> None:
        """Phone numbers in words: runs of number words, from the anchors on, that give nine digits and begin with 6 to 9."""
        pos = 0
        for a, _ in at:
            if a < pos:
                continue
            while before := _spelled_left.search(low, max(pos, a - 30), a):  # words that are too common for an anchor
                a = before.start(1)
            run = _spelled.match(low, a)
            if not run:
                continue
            pos = run.end()
            got, start, end = "", run.start(), 0
            for (a, b), digits in _digits(run[0]):
                if not got:
                    start = run.start() + a
                got, end = got + digits, run.start() + b
                if got in ("34", "0034"):  # the country's number
                    got = ""
                if len(got) >= 9:
                    if len(got) == 9 and got[0] in "6789" and not self._closed[start]:
                        self._take("phone", start, end)
                    got = ""

    def addresses(self, text: str, low: str, streets: list[tuple[int, int]]) -> None:
        small = text.islower()
        for a, b in streets:
            if self._closed[a]:
                continue
            m = _street_rest.match(text, b, b + 2 * NEAR)
            if not m or self._closed[m.end() - 1] or self._closed[m.start("name")]:
                continue
            words = m["name"].split()
            core = [w for w in words if w.lower() not in ("de", "del", "la", "las", "los", "el", "y")]
            if not core or len(core) > 4 or "." in m["name"][:-1]:
                continue
            if m["sep"].isspace() and _counts(core[-1]):
                continue
            end = m.end()
            for _ in range(4):
                f = _floor.match(text, end, end + NEAR)
                if not f or self._closed[f.end() - 1]:
                    break
                end = f.end()
            p = _post.match(text, end, end + NEAR)
            if p and not self._closed[p.end() - 1]:
                end = p.end()
                t = _town_in.match(text, end, end + NEAR) or _town.match(text, end, end + NEAR)
                if not t and small:
                    t = _town_low.match(text, end, end + NEAR)
                if t and not self._closed[t.end() - 1] and bare(t[0].strip(" ,()")) not in self.common_bare:
                    end = t.end()
            elif (t := _town_in.match(text, end, end + NEAR)) and not self._closed[t.end() - 1]:
                end = t.end()
            self._take("address", a, end)

    # -- names -----------------------------------------------------------------------
    def _surname(self, w: str, least: int = 4) -> bool:
        """Could the word be part of a name? Not if it is a common word, with accents or without."""
        low = w.lower()
        return len(w) >= least and low not in NOT_NAMES and low not in self.common and bare(w) not in self.common_bare

    def names(self, text: str, anchors: dict) -> None:
        words = [(m.start(), m.end(), m[0]) for m in _word.finditer(text)]
        n = len(words)
        if not n:
            return
        style = [_style(w) for _, _, w in words]
        # a text that begins every word with a capital says nothing by one
        plain_case = style.count("T") < 0.6 * (style.count("T") + style.count("l")) or n < 5
        at = {a: i for i, (a, _, _) in enumerate(words)}
        given = {at[a] for a, b in anchors.get("given", ()) if a in at and words[at[a]][1] == b}
        used: set[int] = set()

        def between(i: int) -> str | None:
            """What stands between word i and the next; None at the end or across a line."""
            if i < 0 or i + 1 >= n:
                return None
            mid = text[words[i][1] : words[i + 1][0]]
            return None if "\n" in mid else mid.strip(" \t") if mid else "-"

        def free(i: int) -> bool:
            return i not in used and not self._closed[words[i][0]]

        def after_particles(i: int) -> int:
            """The word i, or the one behind the particles that begin there."""
            p = i
            while p + 1 < n and p - i < 2 and words[p][2].lower() in _PARTICLES and between(p) == "":
                p += 1
            return p

        def surnames(i: int, like: str) -> int:
            """Index behind the surnames, at most two, that follow word i; i + 1 if there is none."""
            last = i
            for took in range(2):
                if between(last) != "":
                    break
                p = after_particles(last + 1)
                if not free(p) or not self._surname(words[p][2]) or style[p] != like or took and p in given:
                    break
                last = p
            return last + 1

        def with_title(i: int) -> int:
            """The title before word i, or i."""
            mid = between(i - 1)
            return i - 1 if mid is not None and mid.strip(".ªº") == "" and words[i - 1][2].lower() in _TITLES and free(i - 1) else i

        def take(i: int, j: int) -> None:
            used.update(range(i, j))
            self._take("name", words[i][0], words[j - 1][1])

        # initials and surname: A. Garrigaz
        for i in range(n - 1):
            if len(words[i][2]) > 1 or between(i) != "." or not free(i):
                continue
            j = i + 1
            while len(words[j][2]) == 1 and between(j) == ".":
                j += 1
            if len(words[j][2]) < 4 or not free(j) or not self._surname(words[j][2]) or words[i][0] and text[words[i][0] - 1] == ".":
                continue
            if (style[j] == "l") != words[i][2].islower():
                continue
            take(with_title(i), surnames(j, style[j]))
        # a listed given name
        for i in sorted(given):
            if not free(i):
                continue
            first = last = i
            if between(i - 1) == "" and style[i] == style[i - 1] == "T" and plain_case and free(i - 1) and self._surname(words[i - 1][2], 3):
                first = i - 1  # a given name that isn't listed stands before it
            while between(last) == "" and last + 1 in given and free(last + 1):
                last += 1
            end = surnames(last, style[i])
            if end > last + 1:
                take(with_title(first), end)
            elif between(i - 1) == "," and free(i - 1) and self._surname(words[i - 1][2]) and style[i - 1] == style[i]:
                s = i - 1  # surname first: Coruzabal, Jimena
                if between(s - 1) == "" and free(s - 1) and style[s - 1] == style[s] == "T" and plain_case and self._surname(words[s - 1][2]):
                    s -= 1
                take(s, last + 1)
            elif last > i and self._surname(words[last][2]):
                take(with_title(first), last + 1)  # two given names in a row: the second serves as the surname
            elif first < i:
                take(with_title(first), i + 1)
        # a title and a surname
        for a, _ in anchors.get("title", ()):
            i = at.get(a)
            mid = between(i) if i is not None else None
            if mid is None or mid.strip(".ªº") or not free(i) or not free(i + 1) or not self._surname(words[i + 1][2]):
                continue
            j = i + 1
            if not (style[j] == "T" and plain_case):
                if style[i] != style[j] and len(words[i][2]) > 1 or i and words[i - 1][2].lower() in _ARTICLES or len(words[i][2]) > 4 and words[i][2].lower() not in _ADDRESSES:
                    continue
            take(i, surnames(j, style[j]))
        # a given name that isn't listed: announced before or behind, or two capitals in a row
        cues = sorted(b for _, b in anchors.get("cue", ()))
        behind = sorted(a for a, _ in anchors.get("after", ()))
        for i in range(n - 1):
            mid = between(i)
            if mid not in ("", ",") or not free(i) or not free(i + 1) or not self._surname(words[i][2], 3):
                continue
            p = i + 1 if mid else after_particles(i + 1)
            if not self._surname(words[p][2], 3 if mid else 4) or style[p] != style[i]:
                continue
            end = p + 1 if mid else surnames(i, style[i])
            if end <= i + 1:
                continue
            a, b = words[i][0], words[end - 1][1]
            s = with_title(i)
            # the nearest cue decides: what parts it from the name parts every other one too
            k = bisect_right(cues, words[s][0]) - 1
            cued = k >= 0 and words[s][0] - cues[k] <= NEAR and not text[cues[k] : words[s][0]].strip(" :\u00bf\u00a1,")
            k = bisect_left(behind, b)
            ends = k < len(behind) and behind[k] - b <= NEAR and not text[b : behind[k]].strip(" ")
            if style[i] == "T" and plain_case and not mid:
                if not (cued or ends or p == i + 1 and self._alone(text, a, b)) and (self._sentence_start(text, a) or len(words[i - 1][2]) < 4 and between(i - 1) == ""):
                    continue  # a place behind its preposition, or a sentence's first word
            elif words[i][2].lower() in _ARTICLES or not cued and not (ends and self._begins(text, a) and text[b : b + 4].lower() == " me ") and not (ends and i and words[i - 1][2].lower() == "ayer"):
                continue
            take(s, end)

    @staticmethod
    def _sentence_start(text: str, a: int) -> bool:
        i = _back(text, a, " ¿¡\"«(“—-")
        return i < 0 or text[i] in ".!?…\n:"

    def _begins(self, text: str, a: int) -> bool:
        """No word that is still open stands right before the place."""
        i = _back(text, a)
        return i < 0 or not text[i].isalpha() or bool(self._closed[i])

    @staticmethod
    def _alone(text: str, a: int, b: int) -> bool:
        """The span is a sentence of its own."""
        i = _back(text, a)
        while b < len(text) and text[b] == " ":
            b += 1
        return (i < 0 or text[i] in ".!?…\n") and (b == len(text) or text[b] in ".!?\n")

    # -- all -------------------------------------------------------------------------
    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in the given text, in reading order; [] for null or empty."""
        if not text:
            return []
        folded, places = fold(text, self._known)
        low = folded.lower()
        if len(low) != len(folded):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in folded)
        anchors = self.anchors(low)
        self._out: list[tuple[str, int, int]] = []
        self._closed = bytearray(len(folded) + 1)
        if "mail" in anchors:
            self.emails(folded, anchors["mail"])
        if "digit" in anchors:
            if len(anchors["digit"]) > 6:
                at = [a for a, _ in anchors["digit"]]
                runs = [a for i, a in enumerate(at) if not i or at[i - 1] != a - 1]
                self.accounts(folded, runs)
                self.numbers(folded, low, runs)
                self.phones(folded, runs)
            if "street" in anchors:
                self.addresses(folded, low, anchors["street"])
        elif "street" in anchors and "s/n" in low:
            self.addresses(folded, low, anchors["street"])
        if len(anchors.get("spelled", ())) > 1:
            self.spelled(low, anchors["spelled"])
        if not anchors.keys().isdisjoint(_NAME_ANCHORS) or _initial.search(folded) or _two_capitals.search(folded):
            self.names(folded, anchors)
        out = sorted(self._out, key=lambda x: x[1])
        if places is None:
            return out
        places = [*places, len(text)]
        return [(k, places[a], places[b - 1] + 1) for k, a, b in out]

    def _known(self, word: str) -> bool:
        return word in self.common or len(word) == 1

    def redact(self, text: str | None) -> str | None:
        """The text with every finding replaced by its kind in brackets; null stays null."""
        if not text:
            return text
        out, at = [], 0
        for kind, a, b in self.spans(text):
            if a < at:
                continue
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join([*out, text[at:]])


#: Articles, as they are meant to be and with a needless h or with letters that are confused by sight.
_ARTICLES = frozenset(v for w in "la el le il una un mi nuestra nuestro".split() for v in (w, "h" + w, w.translate(str.maketrans("mn", "wu"))))
#: Titles that are hardly ever common nouns without an article.
_ADDRESSES = frozenset("señorita profesora profesor".split())
_PARTICLES = frozenset(("de", "del", "la", "las", "los", "da", "do", "dos", "di", "van", "von"))
_TITLES = frozenset(t.rstrip(".ª") for t in TITLES)

def _digits(run: str) -> Iterator[tuple[tuple[int, int], str]]:
    """The numbers of a run of number words as digits, each with its place in the run."""
    words = [(m.start(), m.end(), bare(m[0])) for m in re.finditer(r"[^\W\d_]+", run)]
    size = [len(_BARE.get(w, "")) for _, _, w in words]
    i, n = 0, len(words)
    while i < n:
        j, value, width = i, 0, 0
        if size[j] == 3:
            value, width, j = int(_BARE[words[j][2]]), 3, j + 1
        if j < n and size[j] == 2:
            ten = int(_BARE[words[j][2]])
            value, width, j = value + ten, max(width, 2), j + 1
            if ten >= 30 and j + 1 < n and words[j][2] == "y" and size[j + 1] == 1:
                value, j = value + int(_BARE[words[j + 1][2]]), j + 2
        elif j < n and size[j] == 1 and (not width or words[j][2] != "cero"):
            value, width, j = value + int(_BARE[words[j][2]]), max(width, 1), j + 1
        if width:
            yield (words[i][0], words[j - 1][1]), f"{value:0{width}d}"
        i = max(j, i + 1)


def _style(w: str) -> str:
    """T: a capital first; U: all capitals; l: all small; x: anything else."""
    if w.islower():
        return "l"
    if w[0].isupper() and (len(w) == 1 or w[1:].islower()):
        return "T"
    return "U" if w.isupper() else "T" if w[0].isupper() and w[1:].replace("-", "").isalpha() and "-" in w else "x"


def _counts(word: str) -> bool:
    """A form of the verb for counting, one edit off at most: what follows is a quantity, not a house number."""
    word, verb = bare(word), "conto"
    i = next((k for k, (x, y) in enumerate(zip(word, verb)) if x != y), min(len(word), len(verb)))
    return abs(len(word) - len(verb)) <= 1 and (word[i + 1 :] == verb[i + 1 :] or word[i:] == verb[i + 1 :] or word[i + 1 :] == verb[i:] or word[i + 2 :] == verb[i + 2 :] and word[i : i + 2] == verb[i : i + 2][::-1])


def _back(text: str, a: int, skip: str | None = None) -> int:
    """The last place before a that holds none of the characters, or no blank; -1 if there is none."""
    i = a - 1
    while i >= 0 and (text[i].isspace() if skip is None else text[i] in skip):
        i -= 1
    return i


def _iban_end(text: str, a: int) -> int:
    """Where the international account number that begins at the place ends, by its check digits; 0 if there is none."""
    m = _iban.match(text, a)
    end = m.end() if m else 0
    while end > a:
        x = re.sub(r"\s", "", text[a:end]).upper()
        if len(x) < 15:
            break
        if x.isascii() and not text[end : end + 1].isalnum() and text[end - 1].isalnum() and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1:
            return end
        end -= 1
    return 0


def _luhn(card: str) -> bool:
    """The check digit of a payment card is right."""
    digits = [int(c) for c in card if c.isdigit()][::-1]
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and sum(d if not i % 2 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


_BARE = {bare(w): d for w, d in _UNITS.items()} | {bare(w): d for w, d in _TEENS.items()} | {w: d + "0" for w, d in _TENS.items()} | {w: d + "00" for w, d in _HUNDREDS.items()}


def given_list(given_names: DataFrame) -> list[str]:
    """The given names as a list, if they are no more than MOST_GIVEN_NAMES."""
    rows = given_names.select("given_name").where("given_name is not null").distinct().limit(MOST_GIVEN_NAMES + 1).collect()
    if len(rows) > MOST_GIVEN_NAMES:
        raise ValueError(f"more than {MOST_GIVEN_NAMES} given names")
    return [r[0] for r in rows]


def find(rows: DataFrame, given: list[str], common: list[str], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(tbl, row_id, field, kind, ord, start, stop) of every finding in (tbl, row_id, field, text).

    ord numbers the findings of a kind in one text from 1; start and stop are code points of
    the given text. Null and empty texts have no findings; a row delivered twice counts once.
    """
    made: list[Finder] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(Finder(given, common))
        finder = made[0]
        for b in batches:
            out = []
            for tbl, row_id, field, text in zip(b["tbl"], b["row_id"], b["field"], b["text"]):
                seen = dict.fromkeys(kinds, 0)
                for kind, a, z in finder.spans(text):
                    if kind not in seen:
                        continue
                    seen[kind] += 1
                    out.append((tbl, row_id, field, kind, seen[kind], a, z))
            yield pd.DataFrame(out, columns=["tbl", "row_id", "field", "kind", "ord", "start", "stop"])

    schema = "tbl string, row_id long, field string, kind string, ord long, start long, stop long"
    return rows.select("tbl", "row_id", "field", "text").mapInPandas(run, schema).dropDuplicates()


def redact(rows: DataFrame, given: list[str], common: list[str]) -> DataFrame:
    """(tbl, row_id, field, redacted): every text with placeholders; rows delivered twice come out once."""
    made: list[Finder] = []

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Finder(given, common))
        return pd.Series([made[0].redact(t) for t in texts], dtype=object)

    return rows.select("tbl", "row_id", "field", run("text").alias("redacted")).dropDuplicates(["tbl", "row_id", "field"])
