"""Personal information inside free text, by a semi-Markov conditional random field (problem 10).

Segments, not tokens, are scored: a candidate segment gets the sum of the weights of its whole-span features (form, how its words are mostly
written, their endings, words around it) and, between close neighbours, of a transition. Entities are bounded: a name has at most ``MAX_NAME`` words
and a number 15 digits; their boundaries come from generous forms per kind that propose every reading of a place, overlapping ones too. No list of
names, streets or towns decides what is a candidate or a finding. Dynamic programming over the candidates of a window chooses the boundaries
and kinds together; text outside entities scores 0. The weights are trained here, on sentences made by ``pii_training``.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm import wordforms
from rillstone.llm.tokens import TOKENIZER_DIR
from rillstone.llm.wordforms import form_class

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}
MODEL = Path(__file__).with_name("pii_model.json")
#: The most words of a name, which bounds the segments of the field.
MAX_NAME = 8
#: Entities further apart than this, or on different lines, do not influence each other.
NEAR = 6



def _by_first(alternatives: str, then: str = "", depth: int = 1) -> str:
    """A pattern of the same alternatives grouped by their first letters, in their order: fewer are tried at each place, and a search that begins
    with it looks for those letters only. ``then`` is put behind the first letter. Each alternative must begin with plain letters."""
    parts, level = [""], 0
    for ch in alternatives:
        level += (ch == "(") - (ch == ")")
        if ch == "|" and not level:
            parts.append("")
        else:
            parts[-1] += ch
    groups: dict[str, list[str]] = {}
    for x in parts:
        groups.setdefault(x[0], []).append(x[1:])
    deeper = lambda rest: depth > 1 and len(rest) > 1 and all(x[:1].isalpha() and x[1:2] not in ("?", "*", "+", "{") for x in rest)
    return "(?:" + "|".join(f"{ch}{then}" + (_by_first("|".join(rest), "", depth - 1) if deeper(rest) else f"(?:{'|'.join(rest)})") for ch, rest in groups.items()) + ")"


_U = "".join(ch for ch in map(chr, range(0x41, 0x530)) if ch.isupper())
_L = "".join(ch for ch in map(chr, range(0x61, 0x588)) if ch.islower())
# behind the first letter
_CAP_ON = rf"(?:['’][{_U}])?[{_L}]+(?:['’][{_L}]{{2,}})?(?:[{_U}][{_L}]+)*|['’]?[{_U}]+"
_NAME_ON = rf"(?:{_CAP_ON})(?:-(?:[{_U}](?:{_CAP_ON})|[{_L}]+))*"
_INITIAL_ON = rf"\.(?:[{_U}]\.)*(?:-[{_U}]\.)?|(?= [{_U}])"
# Small words inside names.
PARTICLES = frozenset("van von vom de del della dello der den dei degli da das do dos du di la le el al bin binti ibn ben bar ter ten te zu zum zur af av y e und".split())
_PARTICLE = "(?:" + "|".join(sorted(PARTICLES, key=lambda w: (-len(w), w))) + r")(?= )"
# Searches are fast if their pattern begins with characters: what must not stand before them is looked at behind the first one.
_RUN = re.compile(rf"[{_U}](?<![\w@.+/-].)(?<!\w\w['’].)(?:{_NAME_ON}|{_INITIAL_ON})(?:(?:,? | ?, )(?:[{_U}](?:{_NAME_ON}|{_INITIAL_ON})|{_PARTICLE}))*(?![\w@]|['’](?:\w\w|[dtDT]\b)|-\w)")
_PART = re.compile(r"[^\s,]+")
# Titles and labels that stand before names in whatever case.
TITLES = "dr prof mr mrs ms miss mx sir dame herr herrn frau fr mme mlle madame monsieur m sr sra srta señor señora don doña sig signora signor dott mevr dhr meneer mevrouw pan pani".split()
NAME_LABELS = (
    "author|authors|committer|signed-off-by|co-authored-by|reviewed-by|tested-by|acked-by|reported-by|reviewer|assignee|assigned to|owner|contact|contact person|name|full name|first name|last name|surname|attention|attn|cc|bcc|from|to|sender|recipient|approved by|prepared by|signed|signature|patient|employee|"
    "customer|firmado|firma|nombre|apellidos|autor|autora|nom|prénom|auteur|name des kunden|ansprechpartner|ansprechpartnerin|kontakt|unterschrift|nome|naam|imię i nazwisko"
)
#: Titles that names do not begin with; the others are names or initials, too.
_NO_START = frozenset(TITLES) - {"don", "dame", "m", "pan", "sig", "fr"}
_SPACE = "".join(re.escape(ch) for ch in map(chr, range(0x3001)) if ch.isspace())
#: What may stand before a title or a label; texts are searched in lower case with a line end put before them.
_OPEN = rf"[{_SPACE}()\[\]{{}}<>\"'*,;:.|/#&=]"
_TITLE = re.compile(rf"{_OPEN}{_by_first('|'.join(TITLES))}\.? (?=[^\W\d_])")
_NAMED = re.compile(r"[:=][\"'* ]{0,4}(?=[^\W\d_])")
_ANY_NAME = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?(?![\w@]|[./+-]\w)")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+'-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]|\.\w)")
_AT = re.compile(r" at | AT | ?[(\[{<](?:at|AT)[)\]}>] ?")
#: What every form of a written-out at sign holds; found faster than the forms.
_SOME_AT = re.compile(r"[aA][tT](?<=[ (\[{<]..)(?=[ )\]}>])")
_DOT = r"(?: ?[(\[{<](?:dot|DOT)[)\]}>] ?| dot | DOT |\.)"
_HIDDEN_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*?{_DOT}[A-Za-z]{{2,10}}(?![\w@-]|{_DOT}\w)")
#: A digit, looked for by ranges that hold all of them, which is faster than by kind.
_FIRST_DIGIT = r"[0-9\u0660-\U0010ffff](?<=\d)"
_DIGIT = re.compile(_FIRST_DIGIT)
#: Behind the first letter of a word: nothing that belongs to it stands before it.
_ALONE = r"(?<![\w-].)"
_DIGITS = re.compile(
    r"[0-9+(\u0660-\U0010ffff](?<=[\d+(])(?:(?<![\w.#/+@-].)(?<!\d,.)(?<!\w[:=].)(?:(?<=\+)\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d+|(?<=\()\d{1,5}\)[ .-]?\d+|(?<=0)0\d{1,3}[ .-](?:\(\d{1,5}\)[ .-]?)?\d+|(?<=\d)\d*)(?:(?:[ ./-]| ?[/-] ?)\d+)*(?![\w@]|[.:]\d)|"
    r"(?<=[a-z][:=].)(?:(?<=\+)\(?\d|(?<=\()\d|(?<=\d))[\d ()./-]{5,}\d(?!\w))"
)
#: Four digits with nothing between them that a labelled number does not hold.
_FOUR_DIGITS = re.compile(_FIRST_DIGIT + r"(?:[A-Z /.-]*\d){3}")
# What identity numbers are called.
ID_LABELS = (
    r"tax (?:id|identification|file|payer)(?: number| no\.?)?|taxpayer (?:id|number)|tax (?:number|no\.?)|tin|tfn|itin|ein|ssn|social security(?: number| no\.?)?|social insurance(?: number| no\.?)?|sin|nino|ni (?:number|no\.?)|national insurance(?: number| no\.?)?|nhs (?:number|no\.?)|"
    r"passport(?: number| no\.?)?|identity (?:card|number)(?: number| no\.?)?|id card(?: number| no\.?)?|national id(?:entity)?(?: number| card)?|id (?:number|no\.?)|driver'?s licen[cs]e(?: number| no\.?)?|aadhaar(?: number)?|pan card|"
    r"steuer-?id(?:nummer)?|steueridentifikationsnummer|steuernummer|sozialversicherungsnummer|reisepass(?:nummer)?|passnummer|personalausweis(?:nummer)?|ausweis(?:nummer)?|ahv(?:-?nummer)?|"
    r"nir|numéro de sécurité sociale|sécurité sociale|numéro fiscal|passeport|carte d'identité|cni|niss|dni|nie|nif|cif|pasaporte|número de identidad|seguridad social|cédula|curp|rfc|cuit|cuil|rut|cpf|cnpj|passaporte|bilhete de identidade|cartão de cidadão|nif|"
    r"codice fiscale|carta d'identità|bsn|burgerservicenummer|passaporto|paspoort(?: ?nummer)?|nip|rg|rijksregisternummer|pesel|dowód osobisty|personnummer|fødselsnummer|cpr(?:-nummer)?|henkilötunnus|rodné číslo|cnp|oib|egn|tc kimlik(?: no)?"
)
_LABEL = re.compile(rf"{_OPEN}{_by_first(ID_LABELS, depth=2)}(?:,? (?:of|for|von|de|di) (?:[^\s\d]+ ){{1,5}}?(?=(?:is|ist|es|est|è|é|lautet)\b))?(?: ?(?:is|was|ist|war|lautet|es|est|è|é))?[\s:#=.]*(?:\b(?:no|nr|n[º°])\.? ?)?(?=[a-z0-9])")
_VALUE = re.compile(r"[A-Z]{0,6}[ -]?\d[A-Z0-9]*(?:[ /.-][A-Z0-9]*\d[A-Z0-9]*)*(?:[ -]?[A-Z](?![\w]))?")
#: Where an identity number without a label may begin: nine characters at least, of which all its forms consist.
_BARE_START = re.compile(r"[A-Z0-9](?<![\w.+-].)(?=[A-Z\d .+-]{8})")
_BARE_ID = re.compile(
    r"(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} \d\d \d\d \d\d [A-D]|[A-Z]{2}\d{6}[A-D]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[12] \d\d (?:0[1-9]|1[0-3]) \d\d \d{3} \d{3} \d\d|\d{3}\.\d{3}\.\d{3}-\d\d|[A-Z]{6}\d\d[A-EHLMPR-T]\d\d[A-Z]\d{3}[A-Z]|756\.\d{4}\.\d{4}\.\d\d|"
    r"[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d|\d{6}[-+]\d{4}|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}|\d{1,2}\.\d{3}\.\d{3}-[\dK])(?![\w-])"
)
_TOWN = rf"[{_U}][\w'’-]+"
# Words that name a way.
_WAY = (
    r"street|st|avenue|ave|av|road|rd|lane|ln|drive|dr|close|court|ct|square|sq|terrace|ter|way|boulevard|blvd|place|pl|row|crescent|cres|gardens|gdns|hill|grove|mews|parkway|pkwy|walk|highway|hwy|circle|cir|trail|trl|quay|rise|view|vale|"
    r"green|park|loop|alley|plaza|wharf|caddesi|cad|sokak|sokağı"
)
_HOUSE = re.compile(rf"{_FIRST_DIGIT}(?<![\w.#/-]\d)\d{{0,4}}[a-z]?(?:[-/]\d{{1,4}}[a-z]?)?(?:,(?= \D))? (?:[a-z0-9'’à-ÿ-]+\.? ){{1,4}}?{_by_first(_WAY)}\b(?:(?<=\bave)\.|(?<=\bav)\.|(?<=\brd)\.|(?<=\bst)\.(?=,| \D)|(?<=\bdr)\.|(?<=\bln)\.|(?<=\bblvd)\.)?(?: (?:nw|ne|sw|se|north|south|east|west)\b)?(?:,? (?:apt\.?|apartment|suite|ste\.?|unit|flat|floor) ?#?\w+|,? #\d+\w?)?")
_DOOR = re.compile(r"(?<![\w-])(?:flat|apt\.?|apartment|unit|suite|room) ?#?\w+, ?")
# Words that end the name of a way.
_WAY_END = "straße|strasse|str\\.|weg|gasse|platz|allee|ring|damm|ufer|hof|markt|steig|chaussee|straat|laan|gracht|kade|plein|dijk|singel|steenweg|gatan|gata|gate|vägen|gade|vej|veien|vei|katu|tie|stien"
_WAY_ENDS = tuple(_WAY_END.replace("\\.", ".").split("|"))
#: Their last two letters, which are looked up faster.
_WAY_TAILS = frozenset(w[-2:] for w in _WAY_ENDS)
_NUMBER_OF = re.compile(_FIRST_DIGIT + r"(?<=\D\d)\d{0,3}(?P<n>(?:[-/]\d{1,3})?)(?P<x> ?[a-zA-Z])?(?!\w)")
_PREPOSITION = "Am|An der|An den|Auf dem|Auf der|Im|In der|In den|Unter den|Unter der|Zum|Zur|Beim|Hinter der|Vor dem"
_AM = re.compile(rf"{_by_first(_PREPOSITION, _ALONE)} [{_U}][\w-]+(?: [{_U}][\w-]+)? \d{{1,4}}(?: ?[a-z](?!\w))?(?!\w)")
# Words that lead the name of a way.
_LEAD = (
    r"C/|c/|Calle|Cl\.|Avda\.|Av\.|Avenida|Plaza|Pza\.|Paseo|Camino|Carrer|Ronda|Travesía|Rua|R\.|Praça|Travessa|Alameda|Estrada|Largo|Via|Viale|V\.le|Piazza|P\.za|Corso|C\.so|Vicolo|Strada|Contrada|ul\.|ulica|Ul\.|al\.|aleja|pl\.|Strada|Str\.|Bulevardul|Bd\.|"
    r"calle|avenida|plaza|paseo|rua|praça|travessa|largo|via|piazza|viale|corso|rue|Rue|avenue|Avenue|chemin|Chemin"
)
_CALLE = re.compile(rf"{_by_first(_LEAD, _ALONE)} ?(?:(?:de|di|da|do|dos|das|du|des|del|della|dei|d[’']|de la|de los|de las|San|Santa)(?: |(?<=['’])))*\w[\w'’.-]+(?:(?: (?:de|di|da|do|del|della|dei|y|e|la))* [{_U}][\w'’-]+)*,? (?:(?:n\.?|nº|n°|[Nn]o[.:]?|nr\.?) ?)?\d{{1,4}}(?:/?[a-zA-Z](?!\w))?(?:, ?\d{{1,2}}[ºª°](?: ?[A-Z](?!\w)| (?:dcha|izda|izq)\.?)?)?(?:/\d{{1,3}})?")
_RUE = re.compile(rf"{_FIRST_DIGIT}(?<![\w-]\d)\d{{0,3}}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Ii]mpasse|[Aa]llée|[Qq]uai|[Cc]ours|[Rr]oute|[Ss]quare|[Pp]assage|[Ss]entier) (?:de la |de l['’]|des |du |de |d['’])?\w[\w'’-]+(?: (?:de |du |des |la )?[{_U}][\w'’-]+)?")
_BOX_NAME = r"P\.? ?O\.? ?Box|PO Box|Postfach|Apartado|Casella Postale|Boîte postale|BP"
_BOX = re.compile(rf"{_by_first(_BOX_NAME, _ALONE)} \d{{1,6}}(?!\w)")
_FORMS = (("rue", _RUE), ("am", _AM), ("calle", _CALLE), ("box", _BOX))
#: What all forms but the first hold, found faster than each of them.
_LED = re.compile(rf"[^a-zA-Z0-9_-]{_by_first('|'.join((_PREPOSITION, _LEAD, _BOX_NAME)))}[^\n]*\d")
_CODE = r"(?:\d{4,6}|\d{3}-\d{4}|\d{3} \d{2}|\d{2}-\d{3}|\d{5}-\d{3,4}|\d{4} ?[A-Z]{2}|[A-Z]{1,2}\d[A-Z0-9]? ?\d[A-Z]{2}|[A-Z]\d[A-Z] ?\d[A-Z]\d|[A-Z]{1,2}-\d{4,5})(?![\w-]|[/.]\d)"
_TAIL = re.compile(rf"(?P<gap>,? )(?:(?P<code>{_CODE})|(?P<state>[A-Z]{{2}} \d{{5}}(?:-\d{{4}})?(?![\w-])|[A-Z]{{2}}(?!\w))|(?P<town>{_TOWN}))|(?P<glued>,)(?P<tight>{_TOWN})")
_TOKEN_BEFORE = re.compile(r"[^\W_]+|[^\w\s]")

Span = tuple[int, int, str]
#: Features, or a name in ``_MAKERS`` with the arguments they are made from: of those already scored they need not be made.
Group = tuple[str, ...]
#: Start, end, kind and groups of features.
Candidate = tuple[int, int, str, tuple[Group, ...]]


@lru_cache(maxsize=1)
def _backwards(text: str) -> str:
    """The text from its end to its start, in which patterns find what stands before a place."""
    return text[::-1]


_BEFORE = re.compile(r"[ \t_]*(?:([^\W_]+|[^\w\n])[ \t_]*([^\W_]+|[^\w\n])?)?")


def _words_before(text: str, at: int) -> tuple[str, str]:
    """The last two tokens before a place, nearest first, within its line; ``^`` where there is none."""
    one, two = _BEFORE.match(_backwards(text), len(text) - at).groups("^")
    return one[::-1].lower(), two[::-1].lower()


_NEXT = re.compile(r"[ \t_]*([^\W_]+|[^\w\s])?[ \t_]*([^\W_]+|[^\w\s])?")


def _words_after(text: str, at: int) -> tuple[str, str]:
    one, two = _NEXT.match(text, at).groups("$")
    return one.lower(), two.lower()


@lru_cache(maxsize=200_000)
def _word_kind(word: str) -> str:
    """A coarse kind of a neighbouring word: punctuation is itself, numbers 0, words by how they are mostly written."""
    if not word[0].isalnum():
        return word
    return "0" if word[0].isdigit() else form_class(word)


_LABEL_WORDS = frozenset(NAME_LABELS.split("|"))
_CALLING = frozenset(":=\"'*|")
_LONGEST_TITLE = max(map(len, _NO_START))
_LABEL_BEFORE = re.compile(r"[^\n|,;{(&\"*.]*")


def _called(text: str, at: int) -> str:
    """Whether a title (``title``) or the label of a name (``label``) stands before a place, quotes and stars apart."""
    i = at
    while i > 0 and text[i - 1] in " \"'*|_":
        i -= 1
    sign = text[i - 1 : i]
    if sign in (":", "=") or (sign.isalnum() and "|" in text[i:at]):
        i -= sign in (":", "=")
        while i > 0 and text[i - 1] in " \"'*":
            i -= 1
        words = _LABEL_BEFORE.match(_backwards(text), len(text) - i).group()[::-1]
        return "label" if words.strip(" -#>").lower() in _LABEL_WORDS else "-"
    if i == at - 1 and (sign == "." or sign.isalpha()):
        end = i - (sign == ".")
        start, least = end, max(0, end - _LONGEST_TITLE - 1)
        while start > least and text[start - 1].isalpha():
            start -= 1
        return "title" if text[start:end].lower() in _NO_START else "-"
    return "-"


def _left(kind: str, one: str, two: str) -> tuple[tuple[str, ...], ...]:
    """Features of the two words before a span, the nearest first."""
    near = _word_kind(one)
    return (f"{kind}<{one}", f"{kind}<k{near}"), (f"{kind}<<k{_word_kind(two)}{near}",), (f"{kind}<<{two} {one}",)


def _right(kind: str, one: str, two: str) -> tuple[tuple[str, ...], ...]:
    near = _word_kind(one)
    return (f"{kind}>{one}", f"{kind}>k{near}"), (f"{kind}>>k{near}{_word_kind(two)}",), (f"{kind}>>{one} {two}",)


def _cuts(before: str, first: str, last: str, after: str) -> tuple[tuple[str, ...], ...]:
    """Features of the classes inside and outside of both ends of a name."""
    return ((f"cut<{before}", f"cut>{after}", f"cut<{before}{first}", f"cut>{last}{after}"),)


@lru_cache(maxsize=200_000)
def token_class(token: str) -> str:
    """``i`` initial, ``p`` particle, else how the word, or the rarest part of a word with hyphens, is mostly written."""
    if token in PARTICLES:
        return "p"
    if token.endswith(".") or len(token) == 1:
        return "i"
    parts = [form_class(x) for x in re.split(r"['’-]", token) if len(x) > 1] or ["u"]
    return max(parts, key="anocmlku".index)


def _token_features(role: str, token: str) -> tuple[tuple[str, ...], ...]:
    low, c = token.lower(), token_class(token)
    shape = "U" if token.isupper() and len(token) > 1 else "l" if token.islower() else "C" if token[1:].islower() else "x"
    return ((f"{role}:{c}", f"{role}:{shape}{min(len(token), 10)}", f"{role}:-{low[-3:]}", f"{role}:-{low[-2:]}", f"{role}:{low[:2]}-", f"{role}:{c}-{low[-2:]}"),)


def _shape(classes: str, l: str, r: str, called: str) -> tuple[tuple[str, ...], ...]:
    """Features of the classes of a name's words, commas among them, and of the kinds of words around it."""
    plain = classes.replace(",", "")
    n, commas = len(plain), len(classes) - len(plain)
    kinds = "".join("N" if c in "cmlku" else "w" if c in "ano" else c for c in classes)
    return ((
        f"name:{classes if n < 4 else 'long'}", f"name:{kinds if n < 6 else 'long'}", f"name:n{n}", f"name:w{sum(c in 'ano' for c in plain)}", f"name:,{commas}", f"name:{kinds[:6]}<{l}", f"name:{kinds[:6]}>{r}",
        f"name:{kinds[:6]}<{l}>{r}", f"name:<{l}>{r}", f"called:{called}", f"called:{called}:{kinds[:6]}",
    ),)


_MAKERS = {"left": _left, "right": _right, "cuts": _cuts, "token": _token_features, "shape": _shape}


def _parts(group: Group) -> tuple[tuple[str, ...], ...]:
    make = _MAKERS.get(group[0])
    return make(*group[1:]) if make else (group,)


def features(group: Group) -> list[str]:
    return [f for part in _parts(group) for f in part]


def _persons(text: str, out: list[Candidate]) -> None:
    back, size, match_before, match_after = _backwards(text), len(text), _BEFORE.match, _NEXT.match
    for run in _RUN.finditer(text):
        raw = run.group()
        if " " not in raw and "," not in raw:
            if raw.lower() not in _NO_START:
                s, e = run.span()
                one, two = match_before(back, size - s).groups("^")
                one, two = one[::-1].lower(), two[::-1].lower()
                then, later = match_after(text, e).groups("$")
                then, later = then.lower(), later.lower()
                # only behind titles, with or without a point, and some signs is a closer look needed
                word = two if one == "." else one
                called = _called(text, s) if (word in _NO_START if word.isalpha() else one == "." or one in _CALLING or one.isalnum()) else "-"
                out.append((s, e, "person", (("shape", token_class(raw), _word_kind(one), _word_kind(then), called), ("token", "one", raw), ("left", "one", one, two), ("right", "one", then, later))))
            continue
        base = run.start()
        tokens = [(m.start(), m.end(), m.group()) for m in _PART.finditer(raw)]
        n = len(tokens)
        classes = [token_class(t) for _, _, t in tokens]
        comma = ["," in raw[tokens[k][1] : tokens[k + 1][0]] for k in range(n - 1)] + [False]
        rights = [None] * n
        for i in range(n):
            if classes[i] == "p" or tokens[i][2].lower().rstrip(".") in _NO_START:
                continue
            left, shown, commas, named = None, "", 0, False
            for j in range(i, min(n, i + MAX_NAME)):
                if j > i:
                    shown += classes[j - 1] + "," * comma[j - 1]
                    commas += comma[j - 1]
                named = named or classes[j] not in "ip"
                if classes[j] == "p" or (classes[j] == "i" and not named):
                    continue
                if commas > 1:
                    break
                s, e = base + tokens[i][0], base + tokens[j][1]
                role = "one" if i == j else "person"
                if left is None:
                    left, called = _words_before(text, s), _called(text, s)
                    kind_before = _word_kind(left[0])
                if rights[j] is None:
                    rights[j] = _words_after(text, e)
                before = classes[i - 1] + "," * comma[i - 1] if i else "^"
                after = "," * comma[j] + classes[j + 1] if j + 1 < n else "$"
                ends = (("token", "one", tokens[i][2]),) if i == j else (("token", "first", tokens[i][2]), ("token", "last", tokens[j][2]))
                out.append((s, e, "person", (("shape", shown + classes[j], kind_before, _word_kind(rights[j][0]), called), ("cuts", before, classes[i], classes[j], after), *ends, ("left", role, *left), ("right", role, *rights[j]))))


def _lower(text: str) -> str:
    """The text in lower case with every place where it was."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else ch for ch, x in ((ch, ch.lower()) for ch in text))


def _introduced(text: str, low: str) -> Iterator[tuple[str, int]]:
    """``(kind, place)`` after titles and after the labels of names."""
    for m in _TITLE.finditer("\n" + low):
        yield "title", m.end() - 1
    for m in _NAMED.finditer(low):
        if _called(text, m.end()) == "label":
            yield "label", m.end()


def _titled_persons(text: str, low: str, out: list[Candidate]) -> None:
    """Names after titles and labels that are not written in capitals."""
    for kind, s in _introduced(text, low):
        at = s
        classes: list[str] = []
        tokens: list[str] = []
        while len(classes) < MAX_NAME and (m := _ANY_NAME.match(text, at)):
            word = m.group()
            short = len(word.rstrip(".")) == 1
            c = "i" if short else token_class(word.rstrip("."))
            e = m.end() - (not short and word.endswith("."))
            classes.append(c)
            tokens.append(word.rstrip("."))
            if c not in "ip" and any(w[0].islower() and w not in PARTICLES for w in text[s:e].split()):
                nice = sum(x in "cmlku" for x in classes)
                out.append((s, e, "person", ((f"{kind}:{''.join(classes) if len(classes) < 4 else 'long'}", f"{kind}:n{len(classes)}", f"{kind}:N{nice}:{len(classes) - nice}"), ("token", "lowfirst", tokens[0]), ("token", "lowlast", tokens[-1]), ("right", "low", *_words_after(text, e)))))
            if m.end() > e or text[e : e + 1] != " ":
                break
            at = e + 1


def _phone_form(value: str) -> str:
    digits = re.sub(r"\d", "9", value)
    if value.startswith("+"):
        return "plus"
    if value.startswith("00"):
        return "00"
    if re.fullmatch(r"\(9{3}\) ?9{3}[ -.]9{4}", digits) or re.fullmatch(r"9{3}([-. ])9{3}\1[9]{4}", digits):
        return "nanp"
    if re.fullmatch(r"9{3}([. ])9{3}\1[9]{3}", digits):
        return "triples"
    if re.fullmatch(r"9{4}([-/.])99?\1?99?|99?([-/.])99?\2(?:99)?99", digits):
        return "date"
    if not value.startswith("0") and re.fullmatch(r"9{1,3}(?:\.9{1,3}){3}", digits):
        return "quads"
    if value.startswith("("):
        return "bracket"
    if re.fullmatch(r"0\d(?:[ .]\d\d){4}", value):
        return "pairs"
    if value.startswith("0"):
        return "slash" if "/" in value else "zero"
    return "other"


def _lines_with_numbers(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the lines with four digits close to one another, which every labelled number holds."""
    done = 0
    while m := _FOUR_DIGITS.search(text, done):
        done = text.find("\n", m.end())
        done = len(text) if done < 0 else done
        yield text.rfind("\n", 0, m.start()) + 1, done


def _numbers(text: str, lowered: str, out: list[Candidate]) -> None:
    for m in _DIGITS.finditer(text):
        s, e = m.span()
        if e - s < 7:  # digits of the shortest phone number
            continue
        spans = [(s, e, "whole")]
        if " " in (value := m.group()):  # a number of something else may stand right before or after
            spans += [(s, s + value.rindex(" "), "head"), (s + value.index(" ") + 1, e, "tail")]
            parts = re.split(" ?/ | /", value)
            spans += [(s + (at := value.index(x)), s + at + len(x), "part") for x in dict.fromkeys(parts) if x != value]
        for s, e, how in spans:
            value = text[s:e]
            n = sum(ch.isdigit() for ch in value)
            if not 7 <= n <= 15 or value.count("(") != value.count(")") or value[-1] in " /-":
                continue
            groups, form = len(re.findall(r"\d+", value)), _phone_form(value)
            signs = "".join(sorted(set(value) - set("0123456789")))
            if form in ("date", "quads"):
                out.append((s, e, "phone", ((f"phone:{form}",), ("left", "phone", *_words_before(text, s)))))
                continue
            out.append((s, e, "phone", ((f"phone:{form}", f"digits:{n}", f"groups:{min(groups, 6)}", f"phone:{form}:{min(groups, 6)}", f"signs:{signs}", f"phone:{how}"), ("left", "phone", *_words_before(text, s)), ("right", "phone", *_words_after(text, e)))))
    lowered = "\n" + lowered
    for low, high in _lines_with_numbers(text):
        for m in _LABEL.finditer(lowered, low, high + 1):
            v = _VALUE.match(text, m.end() - 1, high)
            if v and sum(ch.isdigit() for ch in v.group()) >= 4:
                value = v.group()
                # the number may be followed by prose that begins with a number or a short word of capitals
                cuts = [k for k in (x.start() for x in re.finditer(" ", value)) if sum(ch.isdigit() for ch in value[:k]) >= 4]
                for k in [*cuts, len(value)]:
                    s, e = v.start(), v.start() + k
                    digits = sum(ch.isdigit() for ch in value[:k])
                    form = re.sub(r"\d+", "9", re.sub(r"[A-Z]+", "A", value[:k]))
                    short = m.group()[1:].strip() in ("nie", "tin", "sin", "pan", "rut", "nir", "cif", "rfc", "egn", "cnp")
                    out.append((s, e, "id_number", (("id:labelled", f"id:short:{short}", f"id:part:{k < len(value)}", f"id:n:{min(digits, 15)}", f"id:signs:{''.join(sorted(set(value[:k]) & set(' -./')))}", f"id:form:{form if len(form) < 8 else 'long'}"), ("right", "id", *_words_after(text, e)))))
    done = 0
    for start in _BARE_START.finditer(text):
        if start.start() < done or not (m := _BARE_ID.match(text, start.start())):
            continue
        s, e = m.span()
        done = e
        out.append((s, e, "id_number", (("id:bare", "id:form:" + re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", m.group()))), ("left", "id", *_words_before(text, s)), ("right", "id", *_words_after(text, e)))))


def _word_start(text: str, end: int) -> int:
    """Where the word, hyphens and apostrophes included, that reaches to ``end`` begins."""
    while end > 0 and (text[end - 1].isalnum() or text[end - 1] in "'’-"):
        end -= 1
    return end


def _places(text: str, low: str) -> Iterator[tuple[str, int, int]]:
    """Street addresses without their towns, by form."""
    if not _DIGIT.search(text):
        return
    doors: dict[int, int] | None = None
    for m in _HOUSE.finditer(low):
        if doors is None:
            doors = {d.end(): d.start() for d in _DOOR.finditer(low)}
        yield "house", doors.get(m.start(), m.start()), m.end()
    for m in _NUMBER_OF.finditer(text):
        way = m.start()
        way -= text[way - 1] == " "
        if low[way - 2 : way] not in _WAY_TAILS or not low.endswith(_WAY_ENDS, 0, way):
            continue
        end = m.end("n")
        start, words = _word_start(text, way - 1), 0
        own = low[start:way] in _WAY_ENDS
        while words < 3:
            if not own or words:
                yield f"strasse{words}", start, m.end()
                if m["x"] and m["x"][0] == " ":
                    yield f"strasse{words}", start, end
            if start < 2 or text[start - 1] != " " or not text[start - 2].isalnum():
                break
            start = _word_start(text, start - 1)
            words += 1
            if not text[start].isupper():
                break
    led = _LED.search("\n" + text)
    for name, form in _FORMS if led else _FORMS[:1]:
        for m in form.finditer(text):
            yield name, m.start(), m.end()


def _addresses(text: str, low: str, out: list[Candidate]) -> None:
    for name, s, e in _places(text, low):
        ends = [(e, "", "")]
        at, tail, towns = e, "", 0
        # postcode, town of up to three words, state: each further piece is another reading
        while len(tail) < 6 and (t := _TAIL.match(text, at)):
            kind = "C" if t["code"] else "S" if t["state"] else "T"
            towns = towns + 1 if kind == "T" and tail[-1:] == "T" and not (t["gap"] or ",").startswith(",") else int(kind == "T")
            if towns > 3 or (kind == "C" and "C" in tail) or (kind == "S" and "S" in tail):
                break
            tail += ("," if (t["glued"] or t["gap"]).startswith(",") else "") + kind
            at = t.end()
            ends.append((at, tail, form_class(t["town"] or t["tight"]) if kind == "T" else ""))
        inner = text[s:e]
        lower = inner == inner.lower()
        case = "".join("0" if w[0].isdigit() else "C" if w[0].isupper() else "l" for w in re.findall(r"\w+", inner))
        named = [w for w in re.findall(r"[^\W\d_]+", inner)]
        kinds = "".join(sorted({form_class(w) for w in named[:-1]})) if named else ""
        for k, (end, tail, last) in enumerate(ends):
            more = ends[k + 1][1][len(tail) :] + ends[k + 1][2] if k + 1 < len(ends) else "$"
            out.append((s, end, "address", ((f"addr:{name}", f"addr:{name}:{lower}", f"addr:{name}:w{kinds}", f"addr:{lower}:small{'a' in kinds}", f"addr:{name}:{case if len(case) < 7 else 'long'}", f"addr:{case[-2:]}:{inner[-1].isalpha()}", f"addr:tail:{tail}", f"addr:last:{last}", f"addr:tail:{tail}:{last}", f"addr:more:{more}", f"addr:more:{tail[-2:]}:{more}"), ("left", "addr", *_words_before(text, s)), ("right", "addr", *_words_after(text, end)))))


def _local_before(text: str, at: int) -> int:
    """Where the name before an at sign begins; ``at`` if there is none."""
    i = at
    while i > 0 and text[i - 1] in _LOCAL_CHARS:
        i -= 1
    while i < at and not text[i].isalnum():
        i += 1
    return i


def _emails(text: str, out: list[Candidate]) -> None:
    at = text.find("@")
    while at >= 0:
        s, host = _local_before(text, at), _HOST.match(text, at + 1)
        if s < at and host:
            e = host.end()
            name, after = text[s:at].lower(), text[e : e + 2]
            out.append((s, e, "email", (("email:plain", f"email:local:{name if name in ('git', 'root', 'noreply', 'www', 'svn', 'hg', 'admin') else '-'}", f"email:path:{after[:1] == ':' and after[1:].strip() != ''}"), ("left", "email", *_words_before(text, s)), ("right", "email", *_words_after(text, e)))))
        at = text.find("@", at + 1)
    done = 0
    for sign in _SOME_AT.finditer(text):
        at = sign.start() - 1
        if text[at] != " " and text[at - 1 : at] == " " and at > done:
            at -= 1
        if at < done or not (m := _AT.match(text, at)):
            continue
        done = m.end()
        host = _HIDDEN_HOST.match(text, m.end())
        s = _local_before(text, m.start()) if host else m.start()
        if s < m.start() and text[m.start() - 1].isalnum():
            e = host.end()
            raw, marker, local = host.group().lower(), m.group(), text[s : m.start()]
            at_form = "word" if marker[0] == " " and marker.strip().isalpha() else "mark"
            dot = "mark" if re.search(r"[\[({<]dot", raw) else "word" if " dot " in raw else "none"
            deep = len(re.findall(_DOT, raw)) > 1
            sign = any(ch in local for ch in "._+-0123456789")
            out.append((s, e, "email", ((f"email:hidden:{at_form}:{dot}", f"email:deep:{deep}:{at_form}:{dot}", f"email:sign:{sign}:{at_form}:{dot}"), ("left", "email", *_words_before(text, s)), ("right", "email", *_words_after(text, e)))))


_ORDER = itemgetter(0, 1, 2)


def candidates(text: str) -> list[Candidate]:
    """All candidate segments with their whole-span features, by start."""
    out: list[Candidate] = []
    low = _lower(text)
    _persons(text, out)
    _titled_persons(text, low, out)
    _emails(text, out)
    _numbers(text, low, out)
    _addresses(text, low, out)
    out.sort(key=_ORDER)
    return out


def windows(text: str, found: list[Candidate]) -> Iterator[list[Candidate]]:
    """Candidates that overlap or lie close to one another on a line; no transition reaches from one window to another."""
    group: list[Candidate] = []
    reach = -1
    for c in found:
        if group and (c[0] - reach > NEAR or "\n" in text[reach : c[0]]):
            yield group
            group, reach = [], -1
        group.append(c)
        reach = max(reach, c[1])
    if group:
        yield group


def transition(a: Candidate, b: Candidate, text: str) -> str | None:
    """The feature of two close entities: their kinds and what is between them; None if they are further apart."""
    gap = text[a[1] : b[0]]
    return f"{a[2]}~{b[2]}:{gap}" if len(gap) <= NEAR else None


_BIAS = {kind: f"bias:{kind}" for kind in KINDS}


def decode(text: str, group: list[Candidate], score: Scorer) -> tuple[list[Candidate], float]:
    """The best set of disjoint segments of a window, by dynamic programming over segment ends."""
    n = len(group)
    if n == 1:
        total = score.own(group[0])
        return (group, total) if total > 0 else ([], 0.0)
    own, link_weight = list(map(score.own, group)), score.weights.get
    order = sorted(range(n), key=lambda k: (group[k][1], group[k][0]))
    ends = [group[k][1] for k in order]
    best: list[tuple[float, int]] = [(0.0, -1)] * n
    # the best so far, by position in the order: what ends further away than NEAR has no transition
    tops: list[tuple[float, int]] = [(0.0, -1)]
    for k in order:
        start = group[k][0]
        near, far = bisect_right(ends, start), bisect_right(ends, start - NEAR - 1)
        top, link = tops[far]
        top += own[k]
        for j in order[far:near]:
            total = best[j][0] + own[k] + link_weight(transition(group[j], group[k], text), 0.0)
            if total > top:
                top, link = total, j
        best[k] = (top, link)
        tops.append(max(tops[-1], (top, k)))
    total, k = tops[-1]
    out = []
    while k >= 0:
        out.append(group[k])
        k = best[k][1]
    return out[::-1], total


class Scorer:
    """Scores of candidates; the weights of a group of features are summed once."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        #: Sums by the parts of a group, so that a score does not depend on how features are grouped.
        self.known: dict[Group, tuple[float, ...]] = {}

    def sums(self, group: Group) -> tuple[float, ...]:
        if len(self.known) > 400_000:
            self.known.clear()
        get = self.weights.get
        got = self.known[group] = tuple([sum([get(f, 0.0) for f in part]) if len(part) > 1 else get(part[0], 0.0) for part in _parts(group)])
        return got

    def own(self, c: Candidate) -> float:
        known = self.known
        return sum([x for g in c[3] for x in (known[g] if g in known else self.sums(g))]) + self.weights.get(_BIAS[c[2]], 0.0)


@lru_cache(maxsize=1)
def model() -> Scorer:
    return Scorer(json.loads(MODEL.read_text()))


def find(text: str | None, score: Scorer | None = None) -> list[Span]:
    """``(start, end, kind)`` of the personal information in a text, in code points, disjoint and in order."""
    if not text:
        return []
    score = score or model()
    out = []
    for group in windows(text, candidates(text)):
        if len(group) > 1:
            out += [(c[0], c[1], c[2]) for c in decode(text, group, score)[0]]
        elif score.own(group[0]) > 0:
            out.append(group[0][:3])
    return out


def redact(text: str | None) -> str | None:
    """The text with each finding replaced by the placeholder of its kind, all else unchanged."""
    if not text:
        return text
    out, at = [], 0
    for s, e, kind in find(text):
        out += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join([*out, text[at:]])


def _finder(names: list[str], folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordforms.use(folder)
        for batch in batches:
            rows = [(d, kind, s, e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s, e, kind in find(t)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            types = [batch.column(0).type, pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, kind, start_pos, end_pos`` of every finding; null and empty texts have none, repeated rows have theirs repeated."""
    names = ["doc_id", "kind", "start_pos", "end_pos"]
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(_finder(names, folder), f"doc_id {kind}, kind string, start_pos bigint, end_pos bigint")


def redact_personal(docs: DataFrame, text: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """All rows and columns, ``text`` with placeholders; null and empty texts stay as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordforms.use(folder)
        for batch in batches:
            done = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([done if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def redaction_report(docs: DataFrame, doc_id: str, source: str, text: str = "text") -> DataFrame:
    """``source, kind, n_found, n_docs``."""
    named = docs.select(F.concat_ws("\x1f", F.col(doc_id).cast("string"), F.coalesce(source, F.lit(""))).alias("doc_id"), F.col(text).alias("text"))
    spans = find_personal(named)
    return spans.withColumn("source", F.split("doc_id", "\x1f")[1]).groupBy("source", "kind").agg(F.count("*").alias("n_found"), F.count_distinct("doc_id").alias("n_docs"))
