"""Candidate spans of personal information and their features: high-recall generators, format and context."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
S = r"[\s  ]"
DASH = r"[-‐-―−]"
I = re.IGNORECASE  # noqa: E741

_DOT = rf"(?:\.|{S}?\(dot\){S}?|{S}?\[dot\]{S}?|{S}dot{S})"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_AT = rf"(?:{S}?[@＠]{S}?|{S}?\(at\){S}?|{S}?\[at\]{S}?|&\#64;|{S}at{S})"
EMAIL = re.compile(rf"(?<![\w.+-])([\w](?:[\w.+-]*[\w])?)({_AT})({_LABEL}(?:{_DOT}{_LABEL})*?{_DOT}[a-z]{{2,}})(?![\w-])(?!{_DOT}[a-z])", I)

_SEP = rf"(?:{S}?{DASH}{S}?|[\s  ./]{{1,2}})"
_EXT = rf"(?:{S}*,?{S}*(?:ext|extension|x|app|durchwahl|poste|доб)\.?{S}*\d{{1,5}}(?!\d))"
_NO_LEFT, _NO_RIGHT = r"(?<![\w+@#])(?<!\d[.,/:-])(?<!\d‑)", r"(?![\w@])(?![./:-]\d)(?!‑\d)"
#: Shapes of telephone numbers, most specific first.
PHONES = [
    rf"(?:\+?1{_SEP})?\(?\d{{3}}\)?{_SEP}?\d{{3}}{_SEP}?\d{{4}}",
    rf"(?:\+44{_SEP}?(?:\(0\))?{_SEP}?|\(?0)\d{{2}}\)?{_SEP}?\d{{4}}{_SEP}?\d{{4}}",
    rf"(?:\(?\+\d{{2}}\)?{_SEP}?(?:\(0\))?{_SEP}?|00\d{{2}}{_SEP}?|\(?0)\d{{2}}\)?{_SEP}?\d{{4,5}}{_SEP}?\d{{3,4}}",
    rf"(?:\(?\+33\)?{_SEP}?|0033{_SEP}?|0)\d(?:{_SEP}?\d\d){{4}}",
    rf"(?:\(?\+\d{{2}}\)?{_SEP}?|00\d{{2}}{_SEP}?)?[5-9]\d{{2}}{_SEP}?(?:\d{{3}}{_SEP}?\d{{3}}|\d\d{_SEP}?\d\d{_SEP}?\d\d)",
    rf"(?:\+7|8){_SEP}?\(?\d{{3}}\)?{_SEP}?\d{{3}}{_SEP}?\d\d{_SEP}?\d\d",
    rf"\(?\+\d{{1,3}}\)?(?:{_SEP}?\(?\d{{1,5}}\)?){{2,5}}",
    rf"\(?(?:0|00[1-9])\d{{1,5}}\)?{_SEP}?\d{{3,8}}(?:{_SEP}?\d{{2,4}}){{0,2}}",
    rf"(?:\+49|0049){_SEP}?(?:\(0\))?{_SEP}?\d{{2,5}}{_SEP}?\d{{3,9}}(?:{_SEP}?\d{{1,5}})?",
    rf"(?:\+34{_SEP}?|0034{_SEP}?)?9\d{_SEP}?\d{{3}}{_SEP}?\d\d{_SEP}?\d\d",
    rf"8{_SEP}?\(?\d{{3,4}}\)?{_SEP}?\d{{2,3}}{_SEP}?\d\d{_SEP}?\d\d",
]
#: Shapes of numbers of identity papers, tax and insurance.
IDS = [
    rf"\d{{3}}(?:{_SEP}?)\d{{2}}(?:{_SEP}?)\d{{4}}",
    rf"[A-Z]{{2}}{_SEP}?\d\d{_SEP}?\d\d{_SEP}?\d\d{_SEP}?[A-Z]",
    rf"\d{{2}}{_SEP}?\d{{3}}{_SEP}?\d{{3}}{_SEP}?\d{{3}}",
    rf"\d{{2}}[.]?\d{{3}}[.]?\d{{3}}{_SEP}?[A-Z]",
    rf"[A-Z]{_SEP}?\d{{7}}{_SEP}?[A-Z]",
    rf"\d{{2}}{_SEP}?\d{{6}}{_SEP}?[A-Z]{_SEP}?\d{{3}}",
    rf"\d(?:{_SEP}?\d\d){{3}}(?:{_SEP}?\d{{3}}){{2}}(?:{S}?/?{S}?\d\d)?",
    rf"\d{{3}}{_SEP}?\d{{3}}{_SEP}?\d{{3}}{_SEP}?\d\d",
    rf"\d{{4}}{_SEP}?\d{{6}}",
    rf"(?!ID|NO|NR|N[IE]|DNI|NI[EFR]|SSN|TIN|TEL|FAX)[A-Z]{{1,3}}{_SEP}?\d{{6,9}}[A-Z]?",
    rf"\d{{2}}{_SEP}?\d{{7}}",
    rf"\d{{2,3}}/\d{{3,8}}/\d{{2,5}}",
    rf"\d{{2}}{_SEP}?\d{{2}}{_SEP}?\d{{6}}|\d{{4}}{_SEP}?№{_SEP}?\d{{6}}|\d{{12}}|\d{{9,10}}|\d{{2}}{_SEP}\d{{10}}",
    rf"\d{{2}}{_SEP}?[A-Z]{{2}}{_SEP}?\d{{5}}|\d{{8}}[A-Z]\d{{3}}",
    rf"(?=[A-Z0-9]{{0,3}}[A-Z])(?=(?:[A-Z]?\d){{2}}|[A-Z]?\d+[A-Z])[A-Z0-9]{{8,10}}",
    rf"\d(?:{_SEP}?\d\d){{3}}(?:{_SEP}?\d{{3}}){{2}}",
    rf"\d\d\.?\d{{3}}\.?\d{{3}}{DASH}?[A-Z]|\d{{8}}{DASH}[A-Z]|[XYZ]{DASH}?\d{{7}}{DASH}?[A-Z]",
    rf"\d\d{_SEP}\d\d{_SEP}\d{{3}}(?:{_SEP}\d{{3}}){{2}}",
]
#: The digits as words, from zero. Fixed values.
DIGIT_WORDS = {
    "en": "zero|oh|one|two|three|four|five|six|seven|eight|nine",
    "de": "null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun",
    "fr": "zéro|un|deux|trois|quatre|cinq|six|sept|huit|neuf",
    "es": "cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve",
    "ru": "ноль|нуль|один|два|три|четыре|пять|шесть|семь|восемь|девять",
}
SPELLED = [re.compile(rf"(?<![\w@-])(?:(?:plus|más|плюс){S}+)?(?:{w})(?:,?{S}+(?:{w})){{6,}}(?:{_EXT})?(?![\w@-])", I) for w in DIGIT_WORDS.values()]
SPELLED_VALUES = [[("zero", "oh"), *((x,) for x in DIGIT_WORDS["en"].split("|")[2:])], [("null",), ("eins",), ("zwei", "zwo"), *((x,) for x in DIGIT_WORDS["de"].split("|")[4:])], [(x,) for x in DIGIT_WORDS["fr"].split("|")], [(x,) for x in DIGIT_WORDS["es"].split("|")], [("ноль", "нуль"), *((x,) for x in DIGIT_WORDS["ru"].split("|")[2:])]]
SPELLED_WORDS = {f(w) for names in DIGIT_WORDS.values() for w in names.split("|") for f in (str.lower, str.title, str.upper)}
HOUR = re.compile(rf"(?<![^\W_])(?:after|at|before|until|nach|um|vor|bis|après|à|avant|después de las|a las|las|после|в|до){S}+$", I)
SPELLED_CUE = re.compile(rf"(?<![\w@-])(?:{'|'.join(DIGIT_WORDS.values())})(?:,?{S}+(?:{'|'.join(DIGIT_WORDS.values())})){{2}}(?![\w-])", I)
PHONE_RE = [re.compile(f"{_NO_LEFT}{p}(?:{_EXT})?{_NO_RIGHT}", I) for p in PHONES]
PHONE_RE += [re.compile(f"{_NO_LEFT}{p}{_NO_RIGHT}") for p in PHONES]
ID_RE = [re.compile(f"{_NO_LEFT}(?:{p}){_NO_RIGHT}") for p in IDS]

#: A letter behind a house number. As a word of its own it may belong to the sentence; see HOUSE_LETTER.
_LETTER = rf"(?:{S}?[^\W\d_]\b)?"
_NUMBER = rf"\d{{1,6}}{_LETTER}(?:{DASH}\d{{1,6}})?"
_FLAT = rf"(?:flat|apt\.?|apartment|unit|suite|ste\.?|room|floor|\#){S}*\d{{1,4}}[a-z]?"
_EN_TYPE = r"(?:street|road|lane|avenue|terrace|way|close|drive|court|square|crescent|gardens|row|hill|place|quay|walk|grove|mews|boulevard|parkway|highway|circle|alley|trail|plaza|(?:st|rd|ave|blvd|ln|dr|ct|sq|pl|hwy|pkwy)(?:\.|(?![\w.])))"
_W = r"[^\W\d_](?:[\w'’.-]*[\w])?"
_DE_TYPE = r"(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|ufer|damm|ring|steig|kai|brücke|markt|hof)"
_DE_STREET = rf"[^\W\d_][\w-]*{_DE_TYPE}"
_DE_PLACE = rf"(?:(?-i:A[mM]|A[nN]|A[uU][fF]|I[mM]|I[nN]|Z[uU][mMrR]|H[iI][nN][tT][eE][rR]|U[nN][tT][eE][rR]){S}+(?:(?:der|dem|den|alten|neuen|hohen|langen){S}+){{0,2}}[^\W\d_][\w-]+|(?:platz|straße|weg|ufer){S}+(?:der|des|am|zum|zur){S}+[^\W\d_][\w-]+)"
_DE_TWO = rf"(?-i:[A-ZÄÖÜ])[\w-]+e[rnms]?{S}+(?:str\.|stra(?:ß|ss)e|allee|gasse|platz|weg)"
#: Before a street that is only the end of a longer one.
PLACE_BEFORE = re.compile(rf"(?<![^\W_])(?:(?-i:Am|An|Auf|Im|In|Zum|Zur|Hinter|Unter|Platz|AM|AN|AUF|IM|ZUM|ZUR|PLATZ)|der|dem|den|des|alten|neuen|hohen|langen|lange|alte|neue|hohe){S}+$", I)
#: An adjective that a name rarely ends in.
HALF_NAME = re.compile(r"(?<!\w)(?:vieux|vieille|grande?|petite?|nouveau|nouvelle|bas(?:se)?|sainte?|beau|belle)$", I)
CAPITAL = re.compile(r" [A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]")
_FR_TYPE = r"(?:rue|boulevard|bd|allée|chemin|impasse|place|quai|avenue|av\.|cours|passage|route|sentier|ruelle|square|faubourg|esplanade|voie|montée)"
_FR_STREET = rf"{_FR_TYPE}{S}+(?:(?:de{S}+la|de{S}+l['’]|du|des|de|d['’]){S}*)?{_W}"
_FR_MORE = rf"(?: (?!avec|merci|dans|pour|et|le|la|les|with|please)[^\W\d_][\w'’-]*)"
_ES_TYPE = rf"(?:calle|c/|paseo|p\.º|avenida|avda\.|plaza|pza\.|camino|ronda|callejón|travesía|carretera|glorieta|pasaje|gran{S}vía|carrer)"
_ES_STREET = rf"{_ES_TYPE}{S}*(?:(?:de{S}+las|de{S}+los|de{S}+la|del|de){S}+)?{_W}(?:{S}{_W})?"
_RU_TYPE = r"(?:ул\.|улица|пер\.|переулок|наб\.|набережная|проспект|просп\.|пр\.|пр-т|площадь|пл\.|бульвар|б-р|шоссе|ш\.|аллея|проезд|тупик)"
_RU_STREET = rf"{_RU_TYPE}{S}*[^\W\d_][\w-]*(?:{S}[^\W\d_][\w-]*)?"
STREETS = [
    rf"(?:{_FLAT},?{S}+)?{_NUMBER},?{S}+(?:(?:St\.|{_W}){S}+){{1,3}}{_EN_TYPE}(?!\w)(?:,{S}*{_FLAT})?",
    rf"(?:{_FLAT},?{S}+)?{_NUMBER},?{S}+(?:(?:St\.|{_W}){S}+){{1,3}}{_EN_TYPE}(?!\w)",
    rf"{_NUMBER},?{S}+(?:(?:St\.|{_W}){S}+){{1,3}}{_EN_TYPE}(?!\w)(?:,{S}*{_FLAT})?",
    rf"{_DE_STREET},?{S}+(?:Nr\.{S}*)?{_NUMBER}(?:,{S}*(?:Whg\.|Wohnung|App\.|Apt\.){S}*\d{{1,4}}[a-z]?)?",
    rf"{_DE_STREET},?{S}+(?:Nr\.{S}*)?{_NUMBER}",
    rf"{_DE_PLACE},?{S}+(?:Nr\.{S}*)?{_NUMBER}(?:,{S}*(?:Whg\.|Wohnung|App\.|Apt\.){S}*\d{{1,4}}[a-z]?)?",
    rf"{_DE_PLACE},?{S}+(?:Nr\.{S}*)?{_NUMBER}",
    rf"{_DE_TWO},?{S}+(?:Nr\.{S}*)?{_NUMBER}",
    rf"\d{{1,6}}{_LETTER}(?:{S}+(?:bis|ter|quater))?,?{S}+{_FR_STREET}(?:,{S}*(?:appt\.?|apt\.|app\.|bât\.?|appartement){S}*\w{{1,4}})?",
    rf"\d{{1,6}}{_LETTER}(?:{S}+(?:bis|ter|quater))?,?{S}+{_FR_STREET}{_FR_MORE}",
    rf"\d{{1,6}}{_LETTER}(?:{S}+(?:bis|ter|quater))?,?{S}+{_FR_STREET}",
    rf"{_ES_STREET},?{S}+(?:n\.?\s?[º°]\.?{S}*|núm\.{S}*)?\d{{1,6}}{_LETTER}(?:,{S}*\d{{1,2}}[.]?[ºª]{S}*(?:[A-Z]\b|izq\.?|dcha\.?)?)?",
    rf"{_ES_STREET},?{S}+(?:n\.?\s?[º°]\.?{S}*|núm\.{S}*)?\d{{1,6}}{_LETTER}",
    rf"{_RU_STREET},?{S}+(?:(?:д\.|дом){S}*)?\d{{1,6}}{_LETTER}(?:/\d{{1,3}})?(?:,{S}*(?:кв\.|квартира|корп\.){S}*\d{{1,4}})?",
    rf"{_RU_STREET},?{S}+(?:(?:д\.|дом){S}*)?\d{{1,6}}{_LETTER}(?:/\d{{1,3}})?",
]
STREET_RE = [re.compile(rf"(?<![\w@./-]){p}(?![\w@])(?!-\d)", I) for p in STREETS]
#: What must be near a number for a street pattern to be tried at all; keeps whole texts cheap to scan. Made of parts of
#: the patterns, with no more around them than the patterns have, so that every match holds a cue.
STREET_CUE = re.compile(rf"(?<={S}){_EN_TYPE}(?!\w)|(?<={S}){_FR_TYPE}{S}|(?<=[\w\s-]){_DE_TYPE},?{S}|(?<![\w@./-])(?:{_ES_TYPE}|{_RU_TYPE}|{_DE_PLACE},?{S}+(?:Nr\.{S}*)?\d)", I)

#: The end of a street whose last letter stands apart; words of one letter, which it may be instead.
HOUSE_LETTER = re.compile(rf"(?<=\d){S}[^\W\d_]$")
LETTER_WORDS = set("aàeéiouyавикосуя")

WORD = re.compile(r"[^\W\d_](?:[\w'’]|-(?=[^\W\d_]))*")
_BETWEEN = re.compile(rf"^(?:{S}{{1,3}}|\.{S}{{0,3}}|,{S}{{1,3}})$")

#: Words before or after a span that speak for or against a kind, in the languages of the texts. Fixed values.
CUES = {
    "phone": r"call|answer|phone|tel|ring|dial|fax|mobile|cell|text me|line|number is|number on|reach|rufen|telefon|mobil|nummer|unter|erreich|anruf|anschluss|wählen|appel|tél|téléphone|portable|numéro|répond|joindre|joint|composez|ligne|llam|teléfono|móvil|responde|marque|línea|número|звон|телефон|тел|моб|номер|отвечает|наберите|линия",
    "id": r"tax|identity|personal|passport|insurance|social|ssn|licen[cs]e|id card|identification|steuer|ausweis|reisepass|führerschein|versicherung|fiscal|identité|passeport|permis|nir|assurance|sécurité|identidad|pasaporte|dni|nie|nif|seguro|seguridad|permiso|carné|паспорт|инн|снилс|удостоверени|страхов|личный|налог",
    "trap": r"order|invoice|serial|batch|version|part |lot |chapter|section|page|line |model|ticket|tracking|parcel|isbn|case |room|size|bestell|rechnung|serie|charge|teil|vorgang|sendung|kapitel|abschnitt|seite|zeile|fassung|modell|zimmer|commande|facture|série|lot|pièce|dossier|colis|chapitre|section|chambre|modèle|pedido|factura|lote|pieza|expediente|paquete|capítulo|sección|página|habitación|заказ|счёт|серия|серийный|партия|деталь|дело|посылка|глав|раздел|страниц|строк|версия|модель|комната|depth|tiefe|profondeur|profundidad|глубина",
    "mail": r"mail|contact|write|repl|sender|from|application|questions|kontakt|schreib|antwort|absender|bewerbung|von|courriel|écri|réponse|expéditeur|dossier|joindre|correo|escrib|respuesta|remitente|solicitud|почт|пиш|ответ|адрес|отправ|заявк",
    "address": r"address|deliver|lives?|house|moved|visit|shop|letter|kept|at|adresse|anschrift|liefer|wohn|umgezogen|laden|haus|brief|livr|habite|déménagé|maison|magasin|lettre|dirección|entreg|vive|mud|casa|tienda|carta|адрес|достав|живёт|прожива|переехал|дом|магазин|письмо",
    "name": r"dr|mr|mrs|ms|prof|dear|sincerely|thanks|thank you|according to|contact person|author|name|accused|spoke with|letter from|prize went to|present were|witness|signed by|with|by|for|to|from|herr|frau|geehrte\w*|grüßen|ansprechpartner|dank|laut|anwesend|zeug\w*|von|an|mit|für|m|mme|monsieur|madame|docteur|cher|chère|cordialement|nom|merci|selon|par|à|de|pour|avec|présents?|témoin|sr|sra|dra|señor|señora|doctor|estimad\w+|atentamente|nombre|contacto|firmó|gracias|según|con|para|presentes|testigo|доктор|д-р|господин|госпожа|уважени\w+|уважаем\w+|имя|контакт|договор подписал|от|для|спасибо|словам|присутству\w+|свидетел\w*|г-н|г-жа|beaucoup|muchas|vielen|many",
    "after": r"signed|opened|said|says|wrote|lives|told|came|unterschrieb|eröffnete|sagte|schrieb|wohnt|kam|a signé|a ouvert|a dit|a écrit|habite|firmó|abrió|dijo|escribió|vive|подписал|открыл|сказал|написал|живёт",
    "thing": r"valve|bridge|method|family|was closed|street|fair|mill|works|harbour|company|gmbh|ltd|verfahren|brücke|ventil|méthode|метод|мост|клапан",
    "article": r"the|a|an|der|die|das|den|dem|le|la|les|l|un|une|el|los|las|una|du|des|del|of|in|im|на|в|с|метод|мост|méthode|método|pont|puente|vanne|válvula|клапан",
}
CUE_RE = {k: re.compile(rf"(?<![^\W_])(?:{v})", I) for k, v in CUES.items()}
NEAR = re.compile(rf"(?<![^\W_])(?:{CUES['name']}){S}?[.,:]?{S}*[\"'«(\[<]?{S}*$", I)
ARTICLE = re.compile(rf"(?<![^\W_])(?:{CUES['article']}){S}+$", I)


def fold(word: str) -> str:
    return unicodedata.normalize("NFC", word).casefold()


#: Common names beside those of a list. Fixed values.
GIVEN = "John Mary James Linda Robert Susan Michael Karen David Emma Thomas Sarah Daniel Laura Peter Alice George Helen Henry Grace Paul Anna Martin Julia Stefan Monika Klaus Ursula Jürgen Sabine Wolfgang Petra Hans Ingrid Andreas Claudia Uwe Birgit Dieter Angela Jean Marie Pierre Claire Luc Sophie Michel Camille Antoine Élodie François Nathalie José María Carlos Lucía Miguel Carmen Javier Ana Pablo Elena Juan Isabel Иван Мария Алексей Ольга Сергей Елена Дмитрий Анна Николай Татьяна Андрей Наталья Михаил Светлана Владимир Екатерина".split()
FAMILY = "Smith Jones Brown Taylor Wilson Davies Evans Walker Wright Green Hall Wood Clark Harris Cooper King Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schäfer Koch Richter Klein Neumann Krüger Braun Dubois Martin Bernard Durand Moreau Lefebvre Leroy Roux Fournier Girard García López Martínez Sánchez Pérez Gómez Fernández Ruiz Díaz Torres Navarro Moreno Иванов Петрова Сидоров Смирнова Кузнецов Попова Васильев Соколова Михайлов Новикова".split()
#: Endings that family names often have, and words with a capital that are no names. Fixed values.
FAMILY_END = re.compile(r"(?:son|sen|man|mann|berg|burg|stein|feld|field|bauer|meyer|maier|ler|ner|er|ez|es|oz|ley|ton|ham|ford|wood|worth|well|ell|eau|ault|ard|ier|oux|et|ini|elli|etti|escu|ski|sky|ska|wicz|ova?|eva?|ina?|ов|ова|ев|ева|ин|ина|енко|ский|ская|ук|юк|ко)$")
NOUNS = set("street road lane avenue terrace way close drive court square crescent gardens row hill place bridge river park station hall house school board council village city town north south east west market harbour hotel gate trust society museum church company works bank club university institute ltd gmbh inc january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday straße weg gasse platz allee ufer brücke markt bahnhof kirche schule rat stadt dorf montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz juni juli oktober dezember rue place pont gare église mairie lundi mardi mercredi jeudi vendredi samedi dimanche calle plaza puente iglesia lunes martes miércoles jueves viernes sábado domingo улица площадь мост театр совет город damen herren gäste sir madam monsieur madame señores the a an in on at if when but and or he she it we they this that der die das ein eine im am wir sie er es le la les un une il elle nous el los las una en y".split())

#: Words before a name that belong to none. Fixed values.
TITLES = set("mr mrs ms miss dr prof professor sir lady dear herr frau doktor monsieur madame mademoiselle mme docteur maître cher chère señor señora señorita don doña doctor doctora profesor profesora estimado estimada господин госпожа доктор профессор уважаемый уважаемая professeur".split())

#: Words whose likeness is remembered at a time.
MOST_READ = 200_000


@dataclass
class Names:
    """What a list of known names tells about names that aren't in it: its beginnings and endings, by part."""

    given: set = field(default_factory=set)
    family: set = field(default_factory=set)
    starts: set = field(default_factory=set)
    ends: dict = field(default_factory=dict)
    strong: set = field(default_factory=set)
    last: dict = field(default_factory=dict)
    seen: dict = field(default_factory=dict)
    common: set = field(default_factory=set)
    liked: set = field(default_factory=set)
    read: set = field(default_factory=set)

    @classmethod
    def of(cls, pairs: list[tuple[str, str]], common: list[tuple[str, str]] = ()) -> Names:
        """`common` names count as known, but no beginnings or endings are learned from them."""
        out = cls({fold(n) for n, p in pairs if n and p == "given"}, {fold(n) for n, p in pairs if n and p == "family"})
        for part in ("given", "family"):
            words = getattr(out, part)
            ends = Counter(w[i:] for w in words for i in range(2, len(w) - 1))
            out.ends[part] = {e for e, n in ends.items() if n >= 3 and len(e) >= 1}
        starts: dict = {}
        for w in out.given | out.family:
            for i in range(2, min(9, len(w) - 1)):
                starts.setdefault(w[:i], set()).add(w[i:])
        known_ends = out.ends["given"] | out.ends["family"]
        out.starts = {s for s, e in starts.items() if len(e & known_ends) >= 2}
        # An ending of one letter counts only behind a beginning that many names share.
        out.strong = {s for s, e in starts.items() if len(e & known_ends) >= 3}
        out.last = {part: {c for c, n in Counter(w[-1] for w in getattr(out, part) if w[:-1] in out.strong).items() if n >= 2} for part in ("given", "family")}
        out.common = {fold(n) for n, _ in common} - out.given - out.family
        for n, p in common:
            getattr(out, p).add(fold(n))
        return out

    def likeness(self, word: str) -> tuple[int, int, int, int]:
        """known given, known family, made like a given name, made like a family name (0, or the length of the ending)."""
        if (got := self.seen.get(word)) is None:
            w = fold(word)
            like = [max((len(w) - i for i in range(2, len(w)) if w[:i] in self.starts and w[i:] in self.ends.get(p, ())), default=0) or int(w[:-1] in self.strong and w[-1:] in self.last.get(p, ())) for p in ("given", "family")]
            got = (int(w in self.given), int(w in self.family), *like)
            self.seen[word] = got
            self.read.add(word)
            if any(got):
                self.liked.add(word)
        return got

    def is_like(self, word: str) -> bool:
        return word in self.liked or any(self.likeness(word))

    def liked_of(self, words: set[str]) -> set[str]:
        """Those of `words` that look like names; words seen before cost one set operation."""
        if len(self.seen) >= MOST_READ:
            # The cache starts anew; what it held is found again.
            self.seen, self.read, self.liked = {}, set(), set()
        new = words - self.read
        return (words & self.liked) | {w for w in new if self.is_like(w)}


def _case(word: str) -> int:
    return 3 if word.isupper() and len(word) > 1 else 2 if word[:1].isupper() else 1


_UPPER, _WORD = r"[A-ZÀ-ÖØ-ÞА-ЯЁ]", r"[^\W\d_](?:[\w'’]|-(?=[^\W\d_]))+"
#: Where a name may stand though no word of it looks like one: an initial before a capital, a comma before an initial, two capitals.
INITIAL = re.compile(rf"(?<![\w.]){_UPPER}\.{S}{{0,3}}(?={_UPPER})")
COMMA_INITIAL = re.compile(rf"(?<![\w@.-])(?={_UPPER}){_WORD},{S}{{1,3}}{_UPPER}\.")
TWO_CAPITALS = re.compile(rf"(?<![\w@.-])(?={_UPPER})({_WORD}),?{S}{{1,2}}(?:{_UPPER}\.{S}?)?(?={_UPPER})({_WORD})(?![\w@])")
#: How far from such a place the words of its name are looked for: an initial or two, a word, the marks between them.
NAME_REACH = 48


def name_spans(text: str, names: Names, words: set[str] | None = None) -> list[tuple[int, int, tuple]]:
    """Pairs of given and family name, initial and family name, or family name, comma and given name or initial.

    Only the surroundings of words made like names, of initials and of two words with capitals are read word by word.
    """
    words = set(WORD.findall(text)) if words is None else words
    places, pairs = [], set()
    if any(len(w) == 1 and w.isupper() for w in words):
        places = [m.span() for m in INITIAL.finditer(text)]
        for m in COMMA_INITIAL.finditer(text):
            places.append(m.span())
            pairs.add(m.start())
    at = 0
    while m := TWO_CAPITALS.search(text, at):
        if m[1].lower() not in NOUNS and m[2].lower() not in NOUNS:
            places.append(m.span())
            pairs.add(m.start())
        at = m.start(2)
    # All words of the text are looked up here, those of the windows only among the liked ones.
    liked = {w for w in names.liked_of(words) if len(w) > 1}
    weak = {w for w in liked if w[:1].islower() and w in names.common}
    # Two such words make a name, one does not.
    for w in liked if len(weak) > 1 else liked - weak:
        if w:
            at = text.find(w)
            while at >= 0:
                places.append((at, at + len(w)))
                at = text.find(w, at + len(w))
    found = []
    for lo, hi in _merged(sorted(places), NAME_REACH, text):
        found += _name_spans(text, lo, hi, names, pairs, liked)
    return found


#: How far the end of a window is moved to the next space.
LONGEST_WORD = 200


def _merged(places: list[tuple[int, int]], reach: int, text: str) -> list[tuple[int, int]]:
    """Stretches within `reach` of the places (in order); they don't overlap, and their ends cut no word of usual length."""
    out: list[tuple[int, int]] = []
    n = len(text)
    for a, b in places:
        lo, hi = max(0, a - reach), min(n, b + reach)
        if out and lo < out[-1][1]:
            if hi <= out[-1][1]:
                continue
            lo = out.pop()[0]
        else:
            least = max(out[-1][1] if out else 0, lo - LONGEST_WORD)
            while lo > least and not text[lo - 1].isspace() and text[lo].isalnum():
                lo -= 1
        most = min(n, hi + LONGEST_WORD)
        while hi < most and not text[hi].isspace():
            hi += 1
        out.append((lo, hi))
    return out


def _name_spans(text: str, lo: int, hi: int, names: Names, pairs: set[int], liked: set[str]) -> list[tuple[int, int, tuple]]:
    words = [(*m.span(), m[0]) for m in WORD.finditer(text, lo, hi)]
    found = []
    for i, (a, b, w) in enumerate(words):
        like = len(w) > 1 and w in liked
        short = len(w) == 1 and w.isupper() and text[b : b + 1] == "."
        if not (like or short or a in pairs) or w.lower() in TITLES:
            continue
        # What follows: up to two initials, then a word.
        j, initials, end = i + 1, 0, b
        gap_comma = False
        while j < len(words) and j <= i + 3:
            c, d, v = words[j]
            gap = text[end:c]
            if not _BETWEEN.match(gap) or (gap.startswith(".") and not (j - 1 >= i and len(words[j - 1][2]) == 1)):
                break
            comma = gap.startswith(",")
            if comma and (gap_comma or j > i + 1 or short):
                break
            gap_comma |= comma
            one = len(v) == 1 and v.isupper() and text[d : d + 1] == "."
            if one:
                if gap_comma:
                    found.append((a, d + 1, (i, j, 1, initials)))
                initials += 1
                end = d
                j += 1
                continue
            if len(v) == 1 or (short and not (v in liked or v[:1].isupper())):
                break
            # In small letters a common name is often a plain word, so both words must look like names then.
            sure = [x in liked and not (x[:1].islower() and x in names.common) for x in (w, v)]
            if any(sure) or (like and v in liked) or (w[:1].isupper() and v[:1].isupper()):
                found.append((a, d, (i, j, int(gap_comma), initials)))
                # A family name, a comma, a given name and a middle initial.
                if gap_comma and j + 1 < len(words) and len(words[j + 1][2]) == 1 and text[words[j + 1][1] : words[j + 1][1] + 1] == "." and text[d : words[j + 1][0]].strip() == "":
                    found.append((a, words[j + 1][1] + 1, (i, j, int(gap_comma), initials + 1)))
            break
    return [(a, b, (words[i][2], words[j][2], comma, initials)) for a, b, (i, j, comma, initials) in found]


#: Before a word that begins a sentence, a line or a text; a word with a capital that goes on before or after a span.
BEGINS = re.compile(r"(?:^|[.!?…:;\n]\s*|[\"'«»(\[<—–-]\s?)$")
GOES_ON, CAME_BEFORE = re.compile(rf"^{S}{_UPPER}\w"), re.compile(rf"{_UPPER}[\w'’-]+{S}$")


def _beside(before: str, after: str) -> list[float]:
    """What stands directly before and after: nothing, a mark, a word or a digit; whether the word before has a capital; its length."""
    left, right = before.rstrip(" \xa0"), after.lstrip(" \xa0")
    mark = lambda t, i: 0.0 if not t or t[i] == "\n" else 4.0 + t[i].isdigit() if t[i].isalnum() else 2.0 if t[i] in ":(<\"«" else 3.0 if t[i] == "," else 1.0
    word = re.search(r"[\w'’.-]*$", left)[0]
    return [mark(left, -1), mark(right, 0), float(word[:1].isupper()), float(len(word))]


def _context(text: str, a: int, b: int, kind: str) -> list[float]:
    before, after = text[max(0, a - 44) : a], text[b : b + 24]
    if kind == "person_name":
        return [*_beside(before, after), *[0.0] * 6, float(bool(CUE_RE["after"].match(after.lstrip(" ,;")))), float(bool(CUE_RE["thing"].search(after[:14]))), float(bool(ARTICLE.search(before))), float(bool(NEAR.search(before)))]
    line = max(before.rfind(". "), before.rfind("\n"), before.rfind("; "))
    out = []
    for k in ("phone", "id", "trap", "mail", "address"):
        last = -1
        for m in CUE_RE[k].finditer(before):
            last = m.start()
        # Whether a cue stands in the same sentence, and how near the last one is.
        out += [float(last > line), 10.0 / (len(before) - last) if last >= 0 else 0.0]
    return out + _beside(before, after)


EMAIL_CUE = re.compile(rf"[@＠]|\(at\)|\[at\]|&\#64;|(?<={S})at{S}[\w.-]+{S}?[\[(]?(?:dot|\.)", I)
AT = ("at", "At", "aT", "AT")
DIGIT = re.compile(r"\d")
LEAST_DIGITS = 5
DENSE = re.compile(r"\d(?:[\W_]{0,3}[^\W\d_]{0,2}[\W_]{0,3}\d){4}")
EXTENSION = re.compile(rf"(?<=\d){_EXT}", I)


def windows(text: str, cue: re.Pattern, reach: int) -> list[tuple[int, int]]:
    """Stretches of the text within `reach` of a cue; they don't overlap and begin and end between words."""
    return _merged([m.span() for m in cue.finditer(text)], reach, text)


def spans(text: str, names: Names) -> list[tuple[str, int, int, list[float]]]:
    """Candidates (kind, start, end, features) of a whole text; they overlap."""
    out: list[tuple[str, int, int, list[float]]] = []
    have: set = set()

    def add(kind: str, a: int, b: int, own: list[float]) -> None:
        if (kind, a, b) not in have:
            have.add((kind, a, b))
            out.append((kind, a, b, own + _context(text, a, b, kind)))

    words = set(WORD.findall(text))
    mailed = "@" in text or "＠" in text or "&#64;" in text or not words.isdisjoint(AT)
    for lo, hi in windows(text, EMAIL_CUE, 320) if mailed else ():
        for m in EMAIL.finditer(text, lo, hi):
            local, at, domain = m.groups()
            sign = 0 if at.strip() in "@＠" and at.strip() else 1 if at == "&#64;" else 2 if "(" in at or "[" in at else 3
            spelled = len(re.findall(r"dot", domain, I))
            add("email", m.start(), m.end(), [sign, float(at != at.strip()), len(local), domain.count(".") + spelled, spelled, float(local.isdigit()), len(re.split(r"\W+", domain)[-1])])
    for lo, hi in windows(text, SPELLED_CUE, 240) if len(words & SPELLED_WORDS) > 1 else ():
        for number, shape in enumerate(SPELLED):
            for m in shape.finditer(text, lo, hi):
                said = list(WORD.finditer(text, m.start(), m.end()))
                # The first word may be the hour of a sentence such as "call after six ...".
                for skip in (0, 1):
                    start, rest = said[skip].start(), [w.group().casefold() for w in said[skip:]]
                    value = [next((d for d, names in enumerate(SPELLED_VALUES[number]) if w in names), 0) for w in rest[:3]]
                    hour = float(bool(HOUR.search(text[max(0, start - 14) : start])))
                    skipped = float(bool(HOUR.search(text[max(0, said[0].start() - 14) : said[0].start()]))) if skip else 0.0
                    add("phone", start, m.end(), [float(len(PHONES) + number), float(len(rest)), hour, skipped, float(bool(DIGIT.search(m.group()))), float(skip), *[0.0] * 4, 1.0, float(m.end() - start), 1.0, 1.0, float(value[0] * 100 + value[1] * 10 + value[2]), float(value[0] * 10 + value[1]), 0.0, 0.0])
    # Every other number has several digits close together, and every street one; none is longer than a window reaches.
    numbered = DIGIT.search(text) is not None
    for lo, hi in windows(text, DENSE, 40) if numbered else ():
        extended = EXTENSION.search(text, lo, hi)
        for kind, shapes in (("phone", PHONE_RE if extended else PHONE_RE[: len(PHONES)]), ("id_number", ID_RE)):
            for number, shape in enumerate(shapes):
                for m in shape.finditer(text, lo, hi):
                    t = m.group()
                    digits = "".join(c for c in t if c.isdigit())
                    if not (7 if kind == "phone" else LEAST_DIGITS) <= len(digits) <= 20:
                        continue
                    groups = re.findall(r"\d+", t)
                    core = "".join(c for c in (re.split(r"[^\W\d_]+", t)[0] if kind == "phone" else t) if c.isdigit())
                    more = bool(re.match(rf"{S}?(?:ext|x|app|poste|доб)\.?{S}*\d", text[m.end() : m.end() + 12], I))
                    own = [number % len(PHONES) if kind == "phone" else number, len(core), len(groups), len(groups[0]), len(digits) > len(core), t[0] == "+" or t[:2] == "(+", "(" in t, "/" in t, "." in t, bool(re.search(DASH, t)), bool(re.search(S, t)), sum(c.isalpha() for c in t), t[:1].isalpha(), t[-1:].isalpha(), int(core[:3] or 0), int(core[:2] or 0), "555" in core[3:8], more]
                    add(kind, m.start(), m.end(), list(map(float, own)))
    for lo, hi in windows(text, DIGIT, 120) if numbered else ():
        if not STREET_CUE.search(text, lo, hi):
            continue
        for number, shape in enumerate(STREET_RE):
            for m in shape.finditer(text, lo, hi):
                apart = HOUSE_LETTER.search(m.group())
                # With the letter and without it.
                for end in (m.end(), m.start() + apart.start()) if apart else (m.end(),):
                    t = text[m.start() : end]
                    letter = 0 if end < m.end() or not apart else 2 if t[-1].lower() in LETTER_WORDS else 1
                    parts, numbers = WORD.findall(t), re.findall(r"\d+", t)
                    flat_after = bool(re.match(r"\s*,\s*(?:apt|flat|app|кв|\d{1,2}\.[º])", text[end : end + 12], I))
                    flat_before = bool(re.search(r"(?:flat|apt\.?)\s+\d+,\s*$", text[max(0, m.start() - 14) : m.start()], I))
                    own = [number, len(t), len(parts), sum(w[:1].isupper() for w in parts) / max(1, len(parts)), len(numbers), "," in t, max(map(len, numbers)), flat_after, flat_before, "\n" in t, sum(map(len, parts)), t[:1].isupper(), bool(PLACE_BEFORE.search(text[max(0, m.start() - 16) : m.start()])), bool(HALF_NAME.search(t)), bool(CAPITAL.match(text, end)), letter, bool(letter and t[-1].isupper()), bool(re.match(r"\s[^\W\d_]\b", text[end : end + 3])), bool(re.match(r"\s[^\W\d_]\s+[^\W\d_]" if not letter else r"\s+[^\W\d_]", text[end : end + 6]))]
                    add("street_address", m.start(), end, list(map(float, own)))
    for a, b, (w, v, comma, initials) in name_spans(text, names, words):
        one = len(w) == 1
        lw, lv = names.likeness(w) if not one else (0, 0, 0, 0), names.likeness(v) if len(v) > 1 else (0, 0, 0, 0)
        first, second = (lv, lw) if comma else (lw, lv)
        add("person_name", a, b, [*map(float, (*first, *second)), float(one or len(v) == 1), comma, initials, _case(w), _case(v), float(_case(w) == _case(v)), len(w), len(v), float("\n" in text[a:b]), float(bool(re.match(rf"[.]?{S}?[A-Z]\.", text[b : b + 4]))), float(bool(re.search(rf"[A-Z]\.{S}?$", text[max(0, a - 3) : a]))), *_shape(text, a, b, w, v, comma)])
    return out


def _shape(text: str, a: int, b: int, w: str, v: str, comma: int) -> list[float]:
    """What a pair of words looks like, whether or not they are known."""
    given, family = (v, w) if comma else (w, v)
    before = text[max(0, a - 24) : a]
    return [float(bool(FAMILY_END.search(family.lower()))), float(bool(FAMILY_END.search(given.lower()))), float(w.lower() in NOUNS), float(v.lower() in NOUNS), float(a == 0 or bool(BEGINS.search(before))), float(bool(GOES_ON.search(text[b : b + 4]))), float(bool(CAME_BEFORE.search(before))), float("-" in w or "-" in v)]


WIDTH = {"email": 7, "phone": 18, "id_number": 18, "street_address": 19, "person_name": 27}


def chosen(candidates: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of overlapping candidates the best, longest, first; in order of place."""
    taken: list[tuple[str, int, int, float]] = []
    for c in sorted(candidates, key=lambda c: (-round(c[3], 2), c[1] - c[2], c[1], c[0])):
        if all(c[2] <= t[1] or c[1] >= t[2] for t in taken):
            taken.append(c)
    return sorted(taken, key=lambda c: c[1])


def table(rows: list[list[float]], kind: str) -> np.ndarray:
    return np.array(rows, float).reshape(-1, WIDTH[kind] + 14)
