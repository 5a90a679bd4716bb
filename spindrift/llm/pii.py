"""Personal information in free text: find it and put typed placeholders in its place.

Numbers are recognised by their format and, where the format has one, their check digit. Addresses of mailboxes and
streets are recognised by their form in six languages. Names are recognised with a lexicon of given and family names
learned from the whole corpus: from mailbox names (`given.family@`), titles (`Dr Family`) and self-introductions. The
corpus statistics are summed before the shuffle and cover every record.

Patterns are tried only around anchors that one pass finds. A window reaches over as many words as what a pattern must
have around its anchor, however long they are, and a match found in it is matched again without the window's end, so
that the finds are those of a search through the whole text.

Placeholders carry a pseudonym, so that equal values stay linked across documents: numbers are brought into one form and
permuted by a keyed Feistel network within their format (check digits are made to fit again), other values get a keyed
tag. The key is the caller's.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.formats import digits, dni_letter, pseudo_date, pseudo_id, pseudo_phone, valid_iban, valid_ssn
from spindrift.runtime import Workspace, hub_join, spread

KINDS = ("name", "email", "phone", "id_number", "address")
#: Names seen in so many records at least enter the lexicon.
MIN_SUPPORT = 2
#: Share of a name's occurrences that begin with a capital.
MIN_CAPITAL = 0.5
#: The lexicon is broadcast up to this number of entries; beyond, it is joined to each record's own words.
BROADCAST_NAMES = 500_000

# Endings of file names, which make "chart@2x.png" no mailbox.
_FILES = "png jpg jpeg gif svg webp bmp ico pdf css js json xml html htm txt csv md py zip gz".split()
_AT = r"(?:\s?[@＠]\s?|&#64;|&#x40;|&commat;|%40|\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:AT|at)\s)"
_DOT = r"(?:\.|&#46;|%2E|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:DOT|dot)\s)"
EMAIL = re.compile(
    rf"(?<![\w.+%-])(?P<local>[^\W_](?:[\w+'-]|[.](?=\w))*){_AT}(?P<host>(?:[^\W_](?:[\w-]*[^\W_])?{_DOT})+)(?P<top>[^\W\d_]{{2,24}})(?![\w@])"
)
_PLAIN_AT = re.compile(r"\s(?:AT|at)\s")

_S = r"[ .\-  /]"
PHONE = re.compile(
    r"(?<![\w.,/-])(?:"
    rf"(?:\+|00[  ]?)[1-9]\d{{0,2}}{_S}?(?:\(\d{{1,4}}\){_S}?)?\d(?:{_S}?\d){{6,12}}"  # international
    rf"|1{_S}?\(?[2-9]\d\d\)?{_S}?[2-9]\d\d{_S}?\d{{4}}"  # North America with 1
    rf"|\([2-9]\d\d\){_S}?[2-9]\d\d{_S}\d{{4}}|[2-9]\d\d([ .\-])[2-9]\d\d\1\d{{4}}"
    r"|\(?0[1-9]\d{1,3}\)?[ /\-]\d{3,8}(?:[ \-]\d{2,6})?"  # trunk zero, two or three groups
    r"|0[1-9](?:[ .\-]\d\d){4}"  # France
    r"|(?<!\d[ .])[69]\d\d[ .]\d\d\d[ .]\d\d\d(?![ .]?\d)"  # Spain, Portugal
    r")(?:\s?(?:ext\.?|x|Durchwahl|poste|int\.|ramal)\s?\d{1,5})?(?![\w]|[.,]\d|-\d)"
)
_CUE_PHONE = re.compile(r"(?i)\b(?:tel|tél|telefon|teléfono|telefono|telefone|téléphone|phone|mobile?|mobil|handy|fax|cell|whatsapp|telemóvel|móvil|cellulare|portable)\b\.?[\"']?\s*[:=]?\s*[\"']?(\+?[\d(][\d ()./\- ]{5,22}\d)(?!\w)")

ID_PLAIN = re.compile(
    r"(?<![\w.,/+-])(?:"
    r"(?P<ssn>\d{3}-\d\d-\d{4})"
    r"|(?P<nino>(?:[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]|QQ) ?\d\d ?\d\d ?\d\d ?[A-D])"
    r"|(?P<dni>\d{8}[ -]?[A-Z])|(?P<nie>[XYZ]-?\d{7}-?[A-Z])"
    r"|(?P<nir>[12]\s?\d\d\s?(?:0[1-9]|1[0-9]|2[0-9]|3[0-9]|4[0-2]|[5-9]\d)\s?(?:\d\d|2[AB])\s?\d{3}\s?\d{3}\s?\d\d)"
    r"|(?P<cf>[A-Z]{6}\d\d[A-EHLMPRST]\d\d[A-Z]\d{3}[A-Z])"
    r"|(?P<passfr>\d\d[A-Z]{2}\d{5})"
    r")(?![\w]|[.,-]\d)"
)
_ID_WORD = (
    r"(?:SSN|SIN|ITIN|TIN|NINO?|NIR|DNI|NIE|NIF|NISS|CPF|BSN|social[ -]security(?: (?:number|no\.?|#))?|(?:national )?insurance (?:number|no\.?)|NI (?:number|no\.?)|tax(?:payer)? ?(?:id|ID|number|no\.?)"
    r"|n(?:°|º|o\.?|uméro) de (?:sécurité sociale|passeport|carte d'identité)|sécurité sociale|n(?:°|º) fiscal|Steuer-?(?:ID|Id|nummer|identifikationsnummer)|Sozialversicherungs-?(?:nummer|nr\.?)|Versicherungs-?(?:nummer|nr\.?)"
    r"|codice fiscale|carta d'identità|documento d'identità|cartão de cidadão|bilhete de identidade|contribuinte|número fiscal|documento de identidad|seguridad social|segurança social"
    r"|[Pp]assport|[Pp]asseport|[Pp]asaporte|[Pp]assaporto|[Pp]assaporte|(?:Reisep|P)ass-?(?:[Nn]r\.?|[Nn]ummer)?|Personal-?[Aa]usweis-?(?:[Nn]r\.?|[Nn]ummer)?|Ausweis-?(?:[Nn]r\.?|[Nn]ummer)?|identity card|ID card|(?:national )?(?:id|ID|identity) (?:number|no\.?))"
)
_CUE_ID = re.compile(rf"(?i:(?<!\w){_ID_WORD})(?:\s?(?:no\.?|nr\.?|n°|nº|n\.|number|num\.?|núm\.?|número|numero|#|is|ist|es|est|è|é))*\s*[:=#]?\s*(?P<id>[A-Z0-9](?:[A-Z0-9]|[ ./-](?=[A-Z]{{0,2}}\d)|[ -](?=[A-Z]\b)){{5,24}})(?!\w)")

_UP = "[A-ZÀ-ÖØ-Þ" + "".join(c for c in map(chr, range(0x100, 0x530)) if c.isupper()) + "]"
_W = rf"{_UP}[\w'’.-]*"
_CITY = rf"{_UP}[\w'’-]+(?: (?i:bay|city|beach|falls|springs|heights|park)\b| (?:sur|am|de|del|do|da|la|le|les|di) {_UP}[\w'’-]+)?"
_TAIL = (
    rf"(?:,?\s(?i:apt|apartment|flat|unit|suite|ste|app|appt|wohnung|piso|int|interno|andar|puerta|esc)\b\.?\s?[\w-]{{1,5}})?(?:,\s?\d{{1,2}}\s?[ºª°](?:\s?\w{{1,3}}\b)?)?"
    rf"(?:(?:,\s?|\s)\d{{5}}(?:-\d{{4}})?\s{_CITY}|(?:,\s?|\s){_CITY}(?:,?\s[A-Z]{{2}})?,?\s\d{{5}}(?!\d)|,\s{_CITY})?"
)
_EN = r"(?:street|road|lane|row|court|drive|blvd\.?|boulevard|avenue|ave\.?|place|square|terrace|hill|close|crescent|way|gardens|grove|mews|parade|parkway|pkwy\.?|highway|walk|rise|st\.?|rd\.?|ln\.?|dr\.?|ct\.?|sq\.?)"
ADDRESSES = (
    re.compile(rf"(?<![\w.,-])(?:(?i:flat|apt\.?|unit|suite)\s\w{{1,4}},\s)?\d{{1,5}}[A-Za-z]?,?\s(?:{_UP}[\w'’-]+\s){{1,4}}(?i:{_EN})(?![\w-]){_TAIL}"),
    re.compile(
        rf"(?<![\w.,-])\d{{1,4}}(?:\s?(?i:bis|ter|quater|[a-d]))?,?\s(?i:rue|avenue|av\.|boulevard|bd|chemin|allée|quai|impasse|place|cours|passage|route|sentier|square|faubourg|voie)\s(?:(?i:des|de\sla|du|de|aux|au|à\sla|sur|saint|sainte|l['’]|d['’]|de\sl['’])\s?)*{_UP}[\w'’-]+(?:[ -](?:(?i:des|de|du|la|le|les|à|au|aux|et|sur)[ -])*{_UP}[\w'’-]+)*{_TAIL}"
    ),
    re.compile(
        rf"(?<!\w)(?i:calle|c/|avenida|avda\.|av\.|plaza|paseo|camino|carrera|ronda|travesía|glorieta|rua|r\.|travessa|praça|largo|estrada|alameda|via|viale|piazza|piazzale|corso|vicolo|strada|lungomare)\s?(?:(?i:de|del|della|delle|degli|dei|di|da|das|do|dos|la|las|el|los|y|e)\s)*{_UP}[\w'’-]+(?:[ -](?:(?i:de|del|della|delle|degli|dei|di|da|das|do|dos|la|las|el|los|y|e)\s)*{_UP}[\w'’-]+){{0,4}},?\s(?i:n\.|n\.?[º°]|no\.|núm\.|num\.|nr\.|s/n)?\s?\d{{1,5}}[A-Za-z]?(?![\w%]|[.,]\d){_TAIL}"
    ),
    re.compile(
        rf"(?<![\w-])(?:(?:{_W}|(?i:am|an der|auf dem|zum|zur|im|in der|unter den))\s){{0,2}}(?:{_UP}[\w'’-]*(?i:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|pfad|chaussee|promenade|markt)|(?:{_UP}[\w'’-]+[ -]){{1,2}}(?i:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|chaussee))\s\d{{1,4}}(?:\s?[a-zA-Z](?!\w))?(?![\w%]|[.,]\d){_TAIL}"
    ),
)

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_GAP = re.compile(r"[ \t ]+(?:[^\W\d_]\.?[ \t ]+)?\Z")
_COMMA_GAP = re.compile(r",[ \t ]+\Z")
# What is said before a family name, and what makes a name one of a firm or thing.
_TITLES = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Madam|Herrn?|Frau|Dr\. med|M|MM|Mme|Mlle|Monsieur|Madame|Mademoiselle|Me|Sr|Sra|Srta|Señora?|Señorita|Don|Doña|Sig|Sig\.ra|Signora?|Dott|Dott\.ssa|Avv|Ing|Senhora?|Exmo|Dra|Doutora?)"
TITLED = re.compile(rf"(?<![\w.])(?:{_TITLES}\.?[  ]+)+(?P<family>{_UP}[^\W\d_]*(?:['’-][^\W\d_]+)*)")
_TITLE_KEYS = {"".join(c for c in t.lower() if c.isalpha()) for t in re.sub(r"[()?]|:", "", _TITLES.replace("n?", "").replace("a?", "")).split("|")}
# Fixed value: titles after which an unknown family name is taken for one.
_SURE = set("mr mrs ms mx dr prof herr herrn frau mme mlle sra srta sig dott avv signora señor señora señorita".split())
FIRM = set("llp plc inc ltd llc gmbh ag sa sas sarl se co corp company holdings holding group partners works systems industries kg ohg spa srl lda sl".split())
INTRO = re.compile(
    r"(?:\b[Mm]y name is|\b[Oo]n behalf of|\bThanks,|\b[Ss]igned,|\b[Ss]incerely,|\b[Rr]egards,|\bName:|\bAttn:|\b[Pp]repared by"
    r"|\b[Ii]ch bin|\b[Mm]ein Name ist|\b[Ee]rstellt von|\bz\. ?Hd\.|\b[Jj]e suis|\b[Jj]e m['’]appelle|\b[Rr]édigé par|\bÀ l['’]attention de"
    r"|\b[Ss]oy|\b[Mm]e llamo|\b[Mm]i nombre es|\b[Pp]reparado por|\bA la atención de|\b[Mm]i chiamo|\b[Ss]ono|\b[Rr]edatto da|\bAll['’]attenzione di"
    r"|\b[Cc]hamo-me|\bO meu nome é|\b[Ss]ou|\b[Ee]laborado por|\bÀ atenção de|\bAo cuidado de|\bA/C)[  ]"
    rf"(?:{_TITLES}\.?[ ])?(?P<a>{_UP}[^\W\d_]*(?:['’-][^\W\d_]+)*)(?P<comma>,?)[  ](?:{_UP}\.[ ])?(?P<b>{_UP}[^\W\d_]*(?:['’-][^\W\d_]+)*)(?![\w'’-])"
)
#: Introductions that name the speaker beyond doubt.
_SELF = re.compile(r"(?i)(?:my name is|mein name ist|je m['’]appelle|me llamo|mi nombre es|mi chiamo|chamo-me|o meu nome é)")
# Fixed value: words of mailboxes that are no person's.
_ROLES = set("info support sales press office investor investors relations customer customers service services help desk team contact media legal accounts billing human resources board data privacy news mail no reply noreply admin".split())
_MAIL_NAME = re.compile(r"([a-z]{3,})[.-]([a-z](?:[a-z'-]*[a-z]){1,})\Z")


# What is searched first, in one pass; the patterns above are only tried around these.
_ANCHORS = {
    "mail": "@|＠|&#64;|&#x40;|&commat;|%40| at |(at)|[at]|{at}|<at>|( at |[ at |(@)|[@]".split("|"),
    "en": "street|road|lane| row|court|drive|blvd|boulevard|avenue| ave|place|square|terrace| hill|close|crescent| way|gardens|grove| mews|parade|parkway|pkwy|highway| walk| rise| st| rd| ln| dr| ct| sq".split("|"),
    "fr": "rue|avenue|av.|boulevard|bd |chemin|allée|quai|impasse|place|cours|passage|route|sentier|square|faubourg|voie".split("|"),
    "es": "calle|c/|avenida|avda.|av.|plaza|paseo|camino|carrera|ronda|travesía|glorieta|rua|r.|travessa|praça|largo|estrada|alameda|via|viale|piazza|piazzale|corso|vicolo|strada|lungomare".split("|"),
    "de": [f"{w} {k}" for w in "straße strasse str. weg gasse platz allee ufer damm ring steig pfad chaussee promenade markt".split() for k in range(10)],
    "id": (
        "ssn|itin|tin|nino|ni number|ni no|nir|dni|nie|nif|niss|cpf|bsn|sin|social security|social-security|insurance n|tax id|tax number|tax no|taxid|taxpayer|sécurité sociale|passeport|passport|pasaporte|passaport|pass|steuer|sozialversicherung|versicherung"
        "|codice fiscale|identità|identité|identidad|cidadão|contribuinte|fiscal|seguridad social|segurança social|ausweis|identity|id card|id number|id no|national id"
    ).split("|"),
    "title": "mr|mrs|ms|miss|mx|dr|prof|sir|madam|herr|frau|m.|m |mm|mme|mlle|monsieur|madame|mademoiselle|me |me.|sr|sra|srta|señor|don |doña|sig|dott|avv|ing.|ing |senhor|exmo|dra|doutor".split("|"),
    "intro": (
        "my name is|on behalf of|thanks,|signed,|sincerely,|regards,|name:|attn:|prepared by|ich bin|mein name ist|erstellt von|z. hd.|z.hd.|je suis|je m'appelle|je m’appelle|rédigé par|attention de"
        "|soy|me llamo|mi nombre es|preparado por|la atención de|mi chiamo|sono|redatto da|attenzione di|chamo-me|meu nome é|sou|elaborado por|atenção de|cuidado de|a/c"
    ).split("|"),
    "phone": "tel|tél|phone|mobil|handy|fax|cell|whatsapp|móvil|portable".split("|"),
}
#: Words before and behind an anchor, itself included, that hold all that its pattern must have; what a pattern may have besides is found by matching on.
_REACH = {"mail": (4, 9), "en": (9, 2), "fr": (4, 14), "es": (3, 20), "de": (6, 4), "id": (8, 26), "title": (3, 4), "intro": (7, 10), "phone": (2, 14)}
_RUN = re.compile(r"\d[\d\s().,/A-Z\-]{4,}")
_TOKEN = re.compile(r"\S+")
#: Anchors are written with plain spaces.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _search():
    """A function giving (position, kinds) of all anchors in a lower-cased text."""
    kinds: dict[str, set[str]] = defaultdict(set)
    for kind, words in _ANCHORS.items():
        for w in words:
            kinds[w].add(kind)
    try:
        import ahocorasick
    except ImportError:
        pattern = re.compile("(?=(" + "|".join(map(re.escape, sorted(kinds, key=len, reverse=True))) + "))")

        def slow(text: str) -> Iterator[tuple[int, tuple[str, ...]]]:
            for m in pattern.finditer(text):
                hit = m.group(1)
                yield m.end() + len(hit) - 1, tuple({k for w, ks in kinds.items() if hit.startswith(w) for k in ks})

        return slow
    tree = ahocorasick.Automaton()
    for w, ks in kinds.items():
        tree.add_word(w, tuple(ks))
    tree.make_automaton()
    return tree.iter


_iter_anchors = None


def anchors(text: str) -> dict[str, list[tuple[int, int]]]:
    """For each kind of anchor the disjoint spans of the text in which its pattern can match."""
    global _iter_anchors
    if _iter_anchors is None:
        _iter_anchors = _search()
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for c in _SPACES:
        low = low.replace(c, " ")
    starts = [m.start() for m in _TOKEN.finditer(text)]
    out: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for end, kinds in _iter_anchors(low):
        at = bisect_right(starts, end) - 1
        for k in kinds:
            before, behind = _REACH[k]
            spans = out[k]
            a = starts[max(0, at - before)] if at >= 0 else 0
            b = starts[at + behind + 1] if at + behind + 1 < len(starts) else len(text)
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return out


def everywhere(text: str) -> dict[str, list[tuple[int, int]]]:
    """What anchors() gives, with the whole text for every kind: to search without windows."""
    return {k: [(0, len(text))] for k in _ANCHORS}


def _around(pattern: re.Pattern, text: str, spans: list[tuple[int, int]]) -> Iterator[re.Match]:
    """The matches that begin in the spans; each is as long as the whole text allows."""
    at = 0
    for a, b in spans:
        at = max(at, a)
        while at <= b and (m := pattern.search(text, at, b)):
            full = pattern.match(text, m.start()) if b < len(text) else m
            if full and full.end() > full.start():
                yield full
                at = full.end()
            else:
                at = m.start() + 1


def number_spans(text: str) -> list[tuple[int, int]]:
    """Spans around runs with six or more digits."""
    out: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        if sum(map(str.isdigit, m.group(0))) >= 6:
            a, b = max(0, m.start() - 9), m.end() + 16
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def folded(word: str) -> str:
    """A name as a lexicon key: letters only, without accents, in lower case."""
    plain = unicodedata.normalize("NFKD", word.casefold())
    return "".join(c for c in plain if c.isalpha())


_keys: dict[str, str] = {}


def _key(word: str) -> str:
    got = _keys.get(word)
    if got is None:
        if len(_keys) > 300_000:
            _keys.clear()
        got = _keys[word] = folded(word)
    return got


# -- numbers, mailboxes, streets ---------------------------------------------------------------------------------------


def emails(text: str, at: dict) -> Iterator[tuple[int, int, str]]:
    for m in _around(EMAIL, text, at["mail"]):
        top, s = m.group("top"), m.group(0)
        if top.lower() in _FILES:
            continue
        if _PLAIN_AT.search(s) and not re.search(r"(?i)\bdot\b", s):
            continue  # "met at noon.then"
        yield m.start(), m.end(), m.group("local")


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[  ]?[A-Z0-9]{4}){2,7}(?:[  ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def account_numbers(text: str, numbers: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Bank accounts, which are no kind of their own here, and whose groups of digits are no phone."""
    for m in _around(_IBAN, text, numbers):
        if valid_iban(m.group(0)):
            yield m.start(), m.end()


def phones(text: str, at: dict, numbers: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for m in _around(PHONE, text, numbers):
        n = len(digits(m.group(0)))
        if 8 <= n <= 20 and not (m.start() >= 1 and text[m.start() - 1] == "(" and text[m.end() : m.end() + 7] == " shares"):
            yield m.start(), m.end()
    for m in _around(_CUE_PHONE, text, at["phone"]):
        if 7 <= len(digits(m.group(1))) <= 15:
            yield m.start(1), m.end(1)


def id_numbers(text: str, at: dict, numbers: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    for m in _around(ID_PLAIN, text, numbers):
        how, s = m.lastgroup, m.group(0)
        if how == "ssn" and not valid_ssn(s):
            continue
        if how == "dni" and dni_letter(digits(s)) != s[-1]:
            continue
        if how == "nie" and dni_letter(str("XYZ".index(s[0])) + digits(s)) != s[-1]:
            continue
        yield m.start(), m.end(), how
    for m in _around(_CUE_ID, text, at["id"]):
        if sum(c.isdigit() for c in m.group("id")) >= 6:
            yield m.start("id"), m.end("id"), "cued"


def addresses(text: str, at: dict) -> Iterator[tuple[int, int]]:
    """In order; where two begin alike or overlap, the first and longest comes first."""
    found = {m.span() for kind, p in zip(("en", "fr", "es", "de"), ADDRESSES) for m in _around(p, text, at[kind])}
    yield from sorted(found, key=lambda x: (x[0], -x[1]))


# -- names -------------------------------------------------------------------------------------------------------------


def seeds(text: str, at: dict) -> Iterator[tuple[str, str]]:
    """(role, key) of names that the text itself shows to be names."""
    for _, _, local in emails(text, at):
        m = _MAIL_NAME.match(re.sub(r"\+.*", "", local.lower()))
        if m:
            yield "given", folded(m.group(1))
            yield "family", folded(m.group(2))
    for m in _around(TITLED, text, at["title"]):
        yield "family", _key(m.group("family"))
    for m in _around(INTRO, text, at["intro"]):
        a, b = _key(m.group("a")), _key(m.group("b"))
        if a in _TITLE_KEYS or b in _TITLE_KEYS:
            continue
        given, family = (b, a) if m.group("comma") else (a, b)
        yield "given", given
        yield "family", family


def _known_words(text: str, given: set, family: set) -> list[tuple[int, int, str]]:
    """Places of the lexicon's words, if the text has both a given and a family name."""
    known = {w: k for w in set(WORD.findall(text)) if (k := _key(w)) in given or k in family}
    if not known or not any(k in given for k in known.values()) or not any(k in family for k in known.values()):
        return []
    pattern = re.compile("|".join(map(re.escape, sorted(known, key=len, reverse=True))))
    out = []
    for m in pattern.finditer(text):
        s, e = m.span()
        if (s and (text[s - 1].isalpha() or (text[s - 1] in "'’-" and s > 1 and text[s - 2].isalpha()))) or (e < len(text) and (text[e].isalpha() or (text[e] in "'’-" and e + 1 < len(text) and text[e + 1].isalpha()))):
            continue  # a part of a longer word
        out.append((s, e, known[m.group(0)]))
    return out


def own_names(text: str, at: dict) -> set[tuple[str, str]]:
    """(given, family) keys of persons the text itself shows to be ones, whatever other texts hold: by self-introductions and mailboxes."""
    out = set()
    for _, _, local in emails(text, at):
        m = _MAIL_NAME.match(re.sub(r"\+.*", "", local.lower()))
        if m and not _ROLES & {*m.groups()}:
            out.add((folded(m.group(1)), folded(m.group(2))))
    for m in _around(INTRO, text, at["intro"]):
        a, b = _key(m.group("a")), _key(m.group("b"))
        if _SELF.match(m.group(0)) and a not in _TITLE_KEYS and b not in _TITLE_KEYS:
            out.add((b, a) if m.group("comma") else (a, b))
    return out


def names(text: str, given: set, family: set, taken: list[tuple[int, int]], at: dict) -> Iterator[tuple[int, int]]:
    """Spans of names outside `taken` spans: two adjacent words of the lexicon in any order and case, with or without a comma or an initial between them and a further family name after them; titles with a family name; self-introductions."""
    words = _known_words(text, given, family)
    i = 0
    while i + 1 < len(words):
        s, e, k = words[i]
        s2, e2, k2 = words[i + 1]
        gap = text[e:s2]
        plain = len(gap) < 8 and _GAP.match(gap)
        sure = min(len(k), len(k2)) >= 3 or (text[s].isupper() and text[s2].isupper())  # short names are usual words too
        if sure and ((plain and (k in given and k2 in family or k in family and k2 in given)) or (len(gap) < 4 and _COMMA_GAP.match(gap) and k in family and k2 in given)):
            end, j = e2, i + 2
            if j < len(words) and plain and words[j][2] in family and len(words[j][2]) >= 3 and _GAP.match(text[e2 : words[j][0]]):
                end, j = words[j][1], j + 1
            if not _of_firm(text, end) and not any(a < end and s < b for a, b in taken):
                yield s, end
            i = j
        else:
            i += 1
    for m in _around(TITLED, text, at["title"]):
        k, title = _key(m.group("family")), m.group(0).split()[0].rstrip(".").lower()
        if (k in family and len(k) >= 3) or title in _SURE:
            if not _of_firm(text, m.end()):
                yield m.start(), m.end()
    for m in _around(INTRO, text, at["intro"]):
        a, b = _key(m.group("a")), _key(m.group("b"))
        if (a in family or a in given or b in family or b in given) and not _of_firm(text, m.end()):
            yield m.start("a"), m.end("b")
    own = {p for p in own_names(text, at) if p[0] not in given or p[1] not in family}
    if own:
        parts = {k for p in own for k in p}
        places = [(m.start(), m.end(), k) for m in WORD.finditer(text) if (k := _key(m.group(0))) in parts and m.group(0)[0].isupper()]
        for (s, e, k), (s2, e2, k2) in zip(places, places[1:]):
            gap = text[e:s2]
            plain = len(gap) < 8 and _GAP.match(gap) and ((k, k2) in own or (k2, k) in own)
            if (plain or (len(gap) < 4 and _COMMA_GAP.match(gap) and (k2, k) in own)) and not _of_firm(text, e2) and not any(a < e2 and s < b for a, b in taken):
                yield s, e2


def _of_firm(text: str, end: int) -> bool:
    rest = text[end : end + 20]
    if rest.startswith((" &", " and Co")):
        m = re.match(r" & \w[\w'’-]* (\w+)", text[end : end + 60])
        return bool(m and m.group(1).lower() in FIRM)
    m = re.match(r"\s(\w+)", rest)
    return bool(m and m.group(1).lower() in FIRM)


# -- mentions ----------------------------------------------------------------------------------------------------------

_BORN = re.compile(r"(?i)\b(?:born(?: on)?|date of birth|dob|geboren am|né(?:e)? le|nacid[oa] el|nat[oa] il|nascid[oa] (?:em|a))\s*[:=]?\s*(\d{4})-(\d\d)-(\d\d)\b")


def find(text: str, given: set | dict, family: set | dict, birth_dates: bool = False, windows: bool = True) -> list[tuple[int, int, str, str]]:
    """Disjoint mentions (start, end, kind, form) in order; where finds overlap, mailboxes win over streets, numbers of identity, phones and names. Without `windows` the patterns are tried everywhere."""
    at = anchors(text) if windows else everywhere(text)
    numbers = number_spans(text) if windows else [(0, len(text))]
    got: list[tuple[int, int, str, str]] = [(s, e, "email", "") for s, e, _ in emails(text, at)]

    def add(s: int, e: int, kind: str, form: str = "") -> None:
        if not any(a < e and s < b for a, b, _, _ in got):
            got.append((s, e, kind, form))

    for s, e in addresses(text, at):
        add(s, e, "address")
    for s, e, form in id_numbers(text, at, numbers):
        add(s, e, "id_number", form)
    accounts = list(account_numbers(text, numbers))
    for s, e in phones(text, at, numbers):
        if not any(a < e and s < b for a, b in accounts):
            add(s, e, "phone")
    if birth_dates:
        for m in _BORN.finditer(text):
            add(m.start(1), m.end(3), "birth_date")
    for s, e in names(text, given, family, [(a, b) for a, b, _, _ in got], at):
        add(s, e, "name")
    return sorted(got)


def same_value(value: str, kind: str) -> str:
    """One form for all ways to write a name, mailbox or street."""
    if kind == "name":
        return " ".join(sorted(k for w in WORD.findall(value) if (k := _key(w)) not in _TITLE_KEYS))
    if kind == "email":
        return re.sub(_DOT, ".", re.sub(_AT, "@", value)).casefold()
    return re.sub(r"\W+", " ", value.casefold()).strip()


def pseudonym(value: str, kind: str, form: str, key: bytes) -> str:
    """The typed placeholder of a mention."""
    if kind == "phone":
        body = pseudo_phone(value, key + b"phone")
    elif kind == "id_number":
        body = pseudo_id(value, form, key)
    elif kind == "birth_date":
        body = pseudo_date(value, key + b"date")
    else:
        body = hmac.new(key + kind.encode(), same_value(value, kind).encode(), hashlib.sha256).hexdigest()[:10]
    return f"[{kind.upper()}:{body}]"


def masked(text: str, found: list[tuple[int, int, str, str]], key: bytes) -> str:
    out, at = [], 0
    for s, e, kind, form in found:
        out += [text[at:s], pseudonym(text[s:e], kind, form, key)]
        at = e
    return "".join(out) + text[at:]


# -- operators ---------------------------------------------------------------------------------------------------------


def name_lexicon(records: DataFrame, text: str = "text", min_support: int = MIN_SUPPORT, min_capital: float = MIN_CAPITAL) -> DataFrame:
    """(key, is_given, is_family) of the names that all records show: in `min_support` or more of them, and written with a capital in a share `min_capital` or more of the places outside mailboxes."""

    def scan(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            roles: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            words: Counter = Counter()
            for t in frame[text]:
                if not t:
                    continue
                at = anchors(t)
                for role, k in set(seeds(t, at)):
                    roles[k][role == "family"] += 1
                words.update(WORD.findall(t))
                for s, e, _ in emails(t, at):
                    words.subtract(WORD.findall(t[s:e]))
            caps, all_ = Counter(), Counter()
            for w, n in words.items():
                k = _key(w)
                all_[k] += n
                if w[0].isupper():
                    caps[k] += n
            yield pd.DataFrame([(k, *roles.get(k, (0, 0)), caps[k], all_[k]) for k in all_.keys() | roles.keys()], columns=["key", "g", "f", "caps", "n"])

    parts = spread(records.select(text)).mapInPandas(scan, "key string, g long, f long, caps long, n long")
    sums = parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("g", "f", "caps", "n")))
    sums = sums.filter((F.col("n") > 0) & (F.length("key") >= 2) & (F.greatest("g", "f") >= min_support) & (F.col("caps") >= min_capital * F.col("n")))
    return sums.select("key", (F.col("g") >= min_support).alias("is_given"), (F.col("f") >= min_support).alias("is_family"))


def _apply(records: DataFrame, lexicon: DataFrame, work, schema: str, text: str, broadcast_names: int) -> DataFrame:
    """work(frame, given, family) over all records; given and family as sets, from a broadcast lexicon or one per row."""
    spark = records.sparkSession
    rows = lexicon.limit(broadcast_names + 1).collect()
    if len(rows) <= broadcast_names:
        sets = spark.sparkContext.broadcast(({r.key for r in rows if r.is_given}, {r.key for r in rows if r.is_family}))

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            given, family = sets.value
            for frame in frames:
                yield work(frame, [given] * len(frame), [family] * len(frame))

        return spread(records).mapInPandas(run, schema)

    at, _ = Workspace(spark, "pii").keep(records.withColumn("_row", F.monotonically_increasing_id()))  # once, as both sides of the join need the same numbers

    def keys(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(n, k) for n, t in zip(frame["_row"], frame[text]) if t for k in {_key(w) for w in WORD.findall(t)}], columns=["_row", "key"])

    words = at.select("_row", text).mapInPandas(keys, "_row long, key string")
    known = hub_join(words, lexicon, "key").groupBy("_row").agg(F.collect_set(F.when(F.col("is_given"), F.col("key"))).alias("_given"), F.collect_set(F.when(F.col("is_family"), F.col("key"))).alias("_family"))  # of one record's words
    joined = at.join(known, "_row", "left").drop("_row")

    def run_each(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield work(frame, [set(x) if x is not None else set() for x in frame["_given"]], [set(x) if x is not None else set() for x in frame["_family"]])

    return joined.mapInPandas(run_each, schema)


def session_key(spark: SparkSession) -> bytes:
    """The key of the setting spindrift.pii.key, else one drawn for this call, under which equal values are linked within its result only."""
    key = spark.conf.get("spindrift.pii.key", None)
    return key.encode() if key else secrets.token_bytes(32)


def mentions(records: DataFrame, lexicon: DataFrame | None = None, text: str = "text", ids: tuple[str, ...] = ("origin", "rec_id"), birth_dates: bool = False, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """One row (ids, kind, n) per record and kind of personal data in it. Null and empty texts have none."""
    lexicon = name_lexicon(records, text) if lexicon is None else lexicon
    kinds = {f.name: f.dataType.simpleString() for f in records.schema}

    def work(frame: pd.DataFrame, given: list, family: list) -> pd.DataFrame:
        out = []
        for row, t, g, f in zip(frame[list(ids)].itertuples(index=False, name=None), frame[text], given, family):
            for kind, n in sorted(Counter(x[2] for x in find(t or "", g, f, birth_dates)).items()):
                out.append((*row, kind, n))
        return pd.DataFrame(out, columns=[*ids, "kind", "n"])

    return _apply(records.select(*ids, text), lexicon, work, ", ".join(f"{c} {kinds[c]}" for c in ids) + ", kind string, n int", text, broadcast_names)


def redacted(records: DataFrame, key: bytes, lexicon: DataFrame | None = None, text: str = "text", birth_dates: bool = False, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """The records with the text's mentions replaced, their number in `mentions` and their kinds in `kinds`; all other columns as they were.

    Who has the key can undo the permuted numbers; it must not be empty. A null text stays null, an empty one empty.
    Columns named `mentions` and `kinds` in the input are replaced.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    lexicon = name_lexicon(records, text) if lexicon is None else lexicon
    rest = [c for c in records.columns if c not in (text, "mentions", "kinds")]
    own = records.select(*rest, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", mentions int, kinds array<string>"

    def work(frame: pd.DataFrame, given: list, family: list) -> pd.DataFrame:
        found = [find(t, g, f, birth_dates) if t else [] for t, g, f in zip(frame[text], given, family)]
        out = frame[[*rest, text]].copy()
        out[text] = [masked(t, x, key) if t else t for t, x in zip(frame[text], found)]
        out["mentions"] = [len(x) for x in found]
        out["kinds"] = [sorted({m[2] for m in x}) for x in found]
        return out

    return _apply(own, lexicon, work, schema, text, broadcast_names)
