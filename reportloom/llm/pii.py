"""Personal information in free text: patterns propose, checks and context decide."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from reportloom.session import ship

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")
#: A proposed span counts from this score.
THRESHOLD = 0.5
#: Characters before and after a span in which context words are looked for.
BEFORE, AFTER = 40, 30

S = r"[^\S\n]"  # white space within a line
#: Capital letters of the scripts that have any, from Latin to Armenian.
UPPER = "[A-Z" + "".join(chr(c) for c in range(0xC0, 0x557) if chr(c).isupper()) + "]"
CAP = rf"{UPPER}[\w'’]*[^\W\d_]"
INITIAL = rf"{UPPER}\."
SURNAME = rf"{CAP}(?:[-‐‑]{CAP})*"
NAME = (
    rf"(?:{SURNAME},{S}+(?:{CAP}(?:{S}+{INITIAL})?|{INITIAL})"
    rf"|(?:{CAP}|{INITIAL})(?:{S}+{INITIAL})*{S}+{SURNAME})"
)
TITLE = rf"(?:(?:Mr|Ms|Mrs|Mx|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Srta)\.?{S}+)"

#: Last words that make a team or a program of what looks like a name.
ROLES = frozenset(
    "bot desk group crew queue reporter robot service squad support team tool watcher account admin list office staff"
    " screen menu mode layout home settings".split()
)

_EMAIL = re.compile(
    r"(?<![\w.+/@-])[A-Za-z0-9][\w.+-]{0,63}"
    r"(?:@|[ \t]@[ \t]|[ \t]?[(\[][ \t]?at[ \t]?[)\]][ \t]?)"
    r"(?:[A-Za-z0-9-]{1,63}(?:\.|[ \t]?[(\[][ \t]?dot[ \t]?[)\]][ \t]?)){1,6}[A-Za-z]{2,24}(?![\w-]|@)",
    re.I,
)
_EMAIL_SIGN = re.compile(r"@|[(\[][ \t]?at[ \t]?[)\]]", re.I)
_EMAIL_WORDS = re.compile(r"mail|contact|reach|write|reply|courriel|correo|kontakt|schreib|écri|escrib|почт|メール|\b(?:to|from|cc|bcc|an|de|à)\b[:,]?\s*$", re.I)
_PHONE = re.compile(
    r"(?<![\w.+:/#-])(?:"
    r"\+\d{1,3}(?:[ .\-  ‑]?\(?\d{1,5}\)?){2,6}"
    r"|\(\d{2,5}\)[ .\-  ‑]?\d{2,4}(?:[ .\-  ‑]?\d{2,5}){1,3}"
    r"|0\d{1,4}(?:[ .\-/  ‑]\d{2,5}){1,4}"
    r"|0\d{9,11}"
    r"|\d{3}[.\-  ‑]\d{3,4}[.\-  ‑]\d{3,4}"
    r")(?![\w]|[.\-:]\d)"
)
_LABELS = (
    r"(?:passport|passeport|pasaporte|Reisepass(?:nummer)?|Pass-Nr|passaporte|residence{s}+(?:ID|permit)|social{s}+security(?:{s}+number)?|SSN"
    r"|tax{s}+(?:ID|number)|TIN|ITIN|national{s}+(?:insurance(?:{s}+number)?|ID)|insurance|NINO|NI{s}+number|identity{s}+(?:card|number)|ID{s}+card"
    r"|Ausweis(?:-?Nr|nummer)?|Personalausweis|Steuer-?ID(?:-?Nr)?|Steuernummer|Sozialversicherungs(?:nummer|-?Nr)|DNI|NIE|NIF|CPF|NIR|BSN|PESEL"
    r"|pi[eè]ce{s}+d['’]identit[eé]|(?:N°|No\.?|num[eé]ro){s}*d['’]identit[eé]|n[uú]mero{s}+de{s}+identi(?:dad|dade)|Documento|RG|BI|ID|паспорт|ИНН|СНИЛС)"
).replace("{s}", S)
_ID_NUMBER = (
    r"(?:[A-Z]{1,3}[-  ]?\d{5,9}(?:[-  ]?[A-Z])?|[A-Z]{2}(?:[ -]?\d{2}){3}[ -]?[A-Z]|[A-Z]-\d{6,8}-[A-Z0-9]|\d{3}[-  ]\d{2}[-  ]\d{4}"
    r"|\d{2}(?:[ .]\d{3}){3}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{8}[-  ]?[A-Z]|\d{9,12})"
)
_IDENTITY = re.compile(rf"(?<![\w])(?P<span>{_ID_NUMBER})(?![\w]|[-.]\d)")
#: A label at the end of what stands before a number.
_LABELLED = re.compile(rf"(?<![\w])(?P<label>{_LABELS})(?:{S}*(?:no|nr|number|n[°º]|num|n[uú]mero)\b\.?)?{S}*[.:#]{{0,2}}{S}*(?:is{S}+)?\Z", re.I)
LABEL_CHARS = 60
#: Numbers that need no label because a checksum confirms them.
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
_CARD = re.compile(r"(?<![\w.-])\d{4}([ -])\d{4}\1\d{4}\1\d{3,4}(?![\w-])")

_EN_STREET = (
    r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Terrace|Ter|Crescent|Cres|Court|Ct|Place|Pl|Square|Sq|Boulevard|Blvd|Way|Close|Row"
    r"|Gardens|Grove|Hill|Mews|Parade|Walk|Quay)"
)
_ADDRESS = re.compile(
    rf"(?<![\w.,/:+-])(?:"
    rf"\d{{1,4}}[A-Za-z]?{S}+(?:{CAP}{S}+){{1,3}}{_EN_STREET}(?![\w])"
    rf"|\d{{1,4}}(?:{S}?(?:bis|ter))?,?{S}+(?i:rue|avenue|all[ée]e|boulevard|place|chemin|impasse|quai|route|cours|passage|square)"
    rf"(?:{S}+(?:de|des|du|la|le|les|l['’]|d['’]))*(?:{S}+|(?<=['’])){CAP}(?:(?:-|{S}){CAP})*"
    rf"|(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|Ronda|Traves[ií]a|Rua|Travessa|Largo|Pra[cç]a|Via|Viale)"
    rf"(?:{S}+(?:de|del|da|do|das|dos|la|las|los|el))*(?:{S}+{CAP}){{1,3}},?{S}+\d{{1,4}}[A-Za-z]?(?![\w])"
    rf"|(?:{CAP}{S}+)?{CAP}(?:{S}|-)(?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring|Ufer|Damm|Steig){S}+\d{{1,4}}{S}?[a-z]?(?![\w])"
    rf"|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|ufer|damm|steig){S}+\d{{1,4}}[a-z]?(?![\w])"
    rf")"
)
#: A cue at the end of what stands before a name.
_CUE = re.compile(
    rf"(?:^|(?<=[^\w]))(?:"
    rf"(?:assignee|reporter|owner|cc|author|name|contact(?:{S}+person)?|attn|signed|from|submitter|reviewer|approver|prénom{S}+nom|nombre|nom){S}*:{S}*"
    rf"|(?:reported|filed|submitted|found|raised|signed|confirmed|sent){S}+by{S}+"
    rf"|(?:thanks|thank{S}+you|credit|credits|kudos){S}+to{S}+"
    rf"|(?:(?:kind|best|warm){S}+regards|regards|sincerely|cheers|thanks|best|merci|cordialement|gracias|saludos|un{S}+saludo|danke|(?:viele|beste|liebe|mit{S}+freundlichen){S}+grüßen?|gruß|grüße"
    rf"|obrigad[oa]|спасибо|с{S}+уважением|よろしくお願いします|ありがとう(?:ございます)?|敬具|以上)[,;.:、。]?{S}*(?:\r?\n{S}*)?"
    rf"|(?:gez|gezeichnet|i\.{S}?A|p\.{S}?p)\.?:?{S}+"
    rf"|^{S}*(?:--|—|–){S}*"
    rf"){TITLE}?\Z|(?:^|(?<=[^\w])){TITLE}\Z",
    re.I | re.M,
)
CUE_CHARS = 60
_SAYS = re.compile(rf"{S}+(?:wrote|said|noted|mentioned)\b", re.I)
#: Names in scripts without capitals stand before an honorific; fixed values: what else stands there.
_HONORED = re.compile(r"(?<![\u3400-\u9fffァ-ヶー가-힣])(?P<span>[\u3400-\u9fffァ-ヶー]{2,8})(?=[ \u3000]?(?:さん|様|氏|先生))|(?<![가-힣])(?P<hangul>[가-힣]{2,4})(?=[ ]?(?:씨|님))")
_NO_PERSON = re.compile(r"担当|管理|利用|皆|客|開発|関係|各位|部|課|係|者$|員$|社$|고객|회원|관리자|담당")
#: Every place where two words look like a name; the score decides.
_NAME = re.compile(rf"(?<![\w@/'’])(?=[^\W\d_a-z])(?=(?P<span>{NAME})(?!\w))")
_NAME_BEFORE = re.compile(
    r"(?:\b(?:spoke|spoken|speak|talked|talk|chatted|met|meeting|worked|working|agreed|checked)\s+(?:with|to)|\b(?:according|thanks|addressed|assigned|forwarded)\s+to"
    r"|\b(?:written|reported|filed|found|raised|signed|confirmed|sent|opened|closed|fixed|reviewed|approved|requested|led)\s+by|\b(?:mail|e-mail|email|message|call|letter|reply|note|word|help|feedback)\s+from"
    r"|\bbehalf\s+of|\b(?:asked|told|emailed|contacted|informed|thanked|called|named|met|says|said|colleague|manager|boss|customer|client|neighbour|dear|hi|hello|hallo|hola|bonjour|liebe|lieber)"
    r"|\b(?:i\s+am|i['’]m|name\s+is|ich\s+bin|je\s+suis|me\s+llamo|soy))[:,]?\s+$", re.I,
)
_NAME_AFTER = re.compile(
    r",?\s+(?:(?:has|had|also|just|already|kindly|then)\s+)?(?:wrote|writes|said|says|asked|asks|told|noted|mentioned|replied|answered|reported|confirmed|complained|called|phoned|emailed|suggested|thinks|believes"
    r"|noticed|explained|agreed|promised|joined|forwarded|escalated|hat\s+geschrieben|schrieb|sagte|a\s+écrit|a\s+dit|escribió|dijo)\b"
    r"|,?\s+from\s+(?:the\s+|our\s+|your\s+)?(?:support|sales|marketing|accounting|engineering|finance|legal|purchasing|security|operations|IT|QA|HR|head\s+office|team|department|office)\b"
)
_NAME_AGAINST_BEFORE = re.compile(r"\b(?:the|a|an|this|that|each|every|our|your|my|its|new|old|der|die|das|den|dem|ein|eine|le|la|les|un|une|el|los|las|una)\s+$", re.I)
_NAME_AGAINST_AFTER = re.compile(
    r"\s+(?:buttons?|menus?|dialogs?|windows?|pages?|tabs?|screens?|settings?|panels?|views?|modes?|keys?|icons?|fields?|apps?|versions?|drivers?|volumes?|tiles?|files?|folders?|servers?|v?\d)", re.I
)
#: First words of sentences and words of programs and streets, none of them part of a name.
_NO_NAME = frozenset(
    "a an and any as at but by each every for from if in into it its my no not of on or our so that the then there these this those to we what when where which while who why with you your i"
    " after before since still also yes please thanks hello hi dear regards best kind am is are was were does did has have had can cannot could should will would may might must"
    " der die das den dem ein eine einer und oder mit von bei nach wenn ich wir ist im am zum zur nicht kein keine le la les un une des du et ou avec il elle je nous en el los las una y o con al"
    " monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december yesterday today tomorrow"
    " error bug issue ticket build version release update file folder page window button dialog tab key ctrl alt shift enter delete result results expected actual summary notes steps open close save"
    " street st road rd lane ln avenue ave drive terrace ter crescent cres court ct square sq boulevard blvd way row gardens grove mews parade walk quay straße strasse platz weg allee".split()
)
#: Given names common in several countries.
_GIVEN = frozenset(
    "adam agnes ahmed aisha alan alba albert alejandro alex alexander alexandra alice alina amanda amelia amina amy ana anastasia andrea andreas andrew angela anita anna anne annika antonio arjun"
    " barbara ben benjamin bernd brian camille carla carlos carmen caroline catherine charles charlotte chiara chris christian christina christine christopher claire clara claudia daniel daniela david"
    " deborah dennis diana diego dmitry dominik dorothy edward elena eleanor elizabeth ella emily emma eric erik eva fatima felix fernando florian francesca francesco francisco frank franziska gabriel"
    " george giulia giuseppe greta hannah hans heidi helen helena henry hugo ibrahim ines ingrid irene isabel isabella ivan jack jacob jakob james jan jana jane jason javier jean jennifer jessica joan"
    " johanna john jonas jorge jose joseph juan julia julian juliette jürgen karen karin karl katarina katharina katherine katrin kevin klaus kristina lara lars laura lauren lea lena leo leon linda lisa"
    " louis louise luca lucas lucy luis luisa lukas magdalena manuel marco margaret maria marie marina mario mark markus marta martin martina mary matthew matthias max maximilian megan michael michelle"
    " miguel mohamed mohammed monika nancy natalia nathan nicholas nicole nina noah olga oliver olivia omar oscar pablo patricia patrick paul paula pedro peter petra philip pierre priya rachel rafael"
    " rebecca ricardo richard robert roberto rosa ruth ryan sabine samuel sandra sara sarah sebastian silvia simon sofia sophia sophie stefan stefanie stephanie stephen steven susan susanne sven"
    " teresa theresa thomas tim tobias tom ulrich ursula uwe valentina vanessa vera victor victoria vincent walter wei wilhelm william wolfgang yusuf yuki zoe".split()
)

_PHONE_WORDS = re.compile(
    r"phone|\btel\b|tél|telefon|teléfono|telefone|\bcall\b|reach|my number|mobile|móvil|handy|\bfax\b|ring me|rufnummer|whatsapp|signal|sms|"
    r"contact|телефон|電話|\bcell\b", re.I,
)
_PHONE_AGAINST = re.compile(
    r"\b(?:frames?|code|bytes|copied|offset|ticket|resolution|build|version|revision|port|pid|serial|differ|error|hash)\b", re.I
)
_ADDRESS_AGAINST = re.compile(r"^\s+(?:volumes?|tiles?|entries|items?|folders?|icons?|mounts?|buttons?|panels?|views?|drives?|shares?|shortcuts?|modes?)\b", re.I)
_ADDRESS_WORDS = re.compile(r"address|\b(?:live|lives|living|located|office|ship|deliver|visit|mail)\b|adresse|anschrift|wohn|dirección|domicil|habit|endereço|адрес|住所", re.I)
_TOWN = re.compile(rf"^,?{S}+(?:\d{{4,6}}{S}+{UPPER}|{UPPER}[\w-]+,?{S}+(?:\d|[A-Z]{{1,2}}\d))")
_ADDRESS_AGAINST_BEFORE = re.compile(r"\b(?:mounts|lists|shows|volumes)\s+$", re.I)


def luhn(digits: str) -> bool:
    """The check of payment cards: every second digit from the right doubled, sum divisible by ten."""
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    """The check of bank accounts: country and check digits moved behind, letters as 10 to 35, rest one."""
    compact = iban.replace(" ", "").upper()
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _weighted(digits: str, weights: list[int]) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights))


def _cpf(digits: str) -> bool:
    rest = [_weighted(digits, list(range(n, 1, -1))) * 10 % 11 % 10 for n in (10, 11)]
    return len(digits) == 11 and rest == [int(digits[9]), int(digits[10])]


def _tax_id(digits: str) -> bool:
    """Eleven digits, the last by ISO 7064 modulus 11,10."""
    if len(digits) != 11:
        return False
    product = 10
    for d in digits[:10]:
        product = ((int(d) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(digits[10])


#: Checks of numbers by their label: the digits, or for Spain the number with its letter.
_CHECKS = {
    "pesel": lambda d, _: len(d) == 11 and (_weighted(d, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) + int(d[10])) % 10 == 0,
    "cpf": lambda d, _: _cpf(d),
    "nir": lambda d, _: len(d) == 15 and (int(d[:13]) + int(d[13:])) % 97 == 0,
    "bsn": lambda d, _: len(d) == 9 and _weighted(d, [9, 8, 7, 6, 5, 4, 3, 2, -1]) % 11 == 0,
    "steuer": lambda d, _: _tax_id(d),
    "dni": lambda d, n: len(d) == 8 and n[-1:].upper() == "TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23],
    "nif": lambda d, n: len(d) == 8 and n[-1:].upper() == "TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23],
}


def checksum(label: str, number: str) -> bool | None:
    """Whether the number passes the check that its label names; None if it names none."""
    low = label.lower()
    check = next((c for name, c in _CHECKS.items() if low.startswith(name)), None)
    return None if check is None else check(re.sub(r"\D", "", number), number)


@dataclass(frozen=True, order=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """The context of a span on its line."""
    before = text[max(0, start - BEFORE) : start].rpartition("\n")[2]
    return before, text[end : end + AFTER].partition("\n")[0]


def _phone_score(text: str, start: int, end: int) -> float:
    span = text[start:end]
    digits = re.sub(r"\D", "", span)
    if not 9 <= len(digits) <= 15:
        return 0.0
    before, after = _around(text, start, end)
    score = 0.3 if span.isdigit() else 0.5  # digits without sign and gaps may be any number
    if re.search(r"\d\s+$", before):
        score -= 0.4  # the rest of a longer number
    if _PHONE_WORDS.search(before) or _PHONE_WORDS.search(after):
        score += 0.4
    elif not before.strip() and not after.strip():
        score += 0.2  # alone on its line
    if _PHONE_AGAINST.search(before[-20:]) or _PHONE_AGAINST.search(after[:12]):
        score -= 0.5
    return score


def _name_score(text: str, start: int, end: int) -> float:
    """Evidence for and against what looks like a name."""
    span = text[start:end]
    words = re.findall(r"[^\W\d_]+", span)
    low = [w.lower() for w in words]
    if low[0] in ROLES or low[-1] in ROLES or any(c.isdigit() for c in span):
        return 0.1
    if _CUE.search(text[max(0, start - CUE_CHARS) : start]) or (text[max(0, start - 3) : start].lower() == "as " and _SAYS.match(text, end)):
        return 0.8
    if text[start - 1 : start] in (".", "-") and start:
        return 0.1  # within a file name or a compound
    if not _NO_NAME.isdisjoint(w for w in low if len(w) > 1):
        return 0.1
    before, after = _around(text, start, end)
    score = 0.3
    if (low[-1] if "," in span else low[0]) in _GIVEN:
        score += 0.3
    if _NAME_BEFORE.search(before):
        score += 0.3
    if _NAME_AFTER.match(after):
        score += 0.3
    if any(len(w) == 1 for w in words[1:-1]):
        score += 0.1  # a middle initial
    if _NAME_AGAINST_BEFORE.search(before):
        score -= 0.4
    if _NAME_AGAINST_AFTER.match(after):
        score -= 0.4
    if span.isupper() and (re.search(r"\b[A-Z]{2,}\W*$", before) or re.match(r"\W*[A-Z]{2,}\b", after)):
        score -= 0.4  # amid capitals
    return min(score, 0.75)  # a cue beside it is worth more


def _identity_score(label: str, text: str, start: int, end: int) -> float:
    """A label makes an identity number, a passed checksum confirms it; written-down numbers often fail theirs."""
    sound = checksum(label, text[start:end])
    score = 0.7 + (0.2 if sound else 0.0) - (0.1 if sound is False else 0.0)
    return score - (0.3 if label.lower() in ("id", "bi", "rg", "insurance") and _PHONE_AGAINST.search(_around(text, start, end)[0]) else 0.0)


def propose(text: str) -> Iterator[Span]:
    """Every span that a pattern proposes, with its score after checks and context."""
    if _EMAIL_SIGN.search(text):
        for m in _EMAIL.finditer(text):
            start, end = m.span()
            if text[start:end].lower().startswith("mailto"):
                continue
            before, after = _around(text, start, end)
            in_url = re.search(r"://[^\s]*$", before) or ("://" in before[-12:] and text[end : end + 1] in (":", "/"))
            cued = _EMAIL_WORDS.search(before) or _EMAIL_WORDS.search(after)
            yield Span(start, end, "email", 0.6 + (0.3 if cued else 0.0) - (0.7 if in_url else 0.0))
    for m in _IDENTITY.finditer(text):
        start, end = m.span("span")
        label = _LABELLED.search(text[max(0, start - LABEL_CHARS) : start])
        if label:
            yield Span(start, end, "identity_number", _identity_score(label["label"], text, start, end))
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield Span(*m.span(), "identity_number", 0.8)
    for m in _CARD.finditer(text):
        if luhn(re.sub(r"\D", "", m[0])):
            yield Span(*m.span(), "identity_number", 0.6)
    for m in _PHONE.finditer(text):
        yield Span(*m.span(), "phone", _phone_score(text, *m.span()))
    for m in _ADDRESS.finditer(text):
        start, end = m.span()
        before, after = _around(text, start, end)
        score = 0.6 + (0.2 if _ADDRESS_WORDS.search(before) or _TOWN.search(after) else 0.0)
        against = _ADDRESS_AGAINST.search(after) or _ADDRESS_AGAINST_BEFORE.search(before)
        yield Span(start, end, "street_address", score - (0.5 if against else 0.0))
    for m in _NAME.finditer(text):
        start, end = m.span("span")
        yield Span(start, end, "person_name", _name_score(text, start, end))
    for m in _HONORED.finditer(text):
        start, end = m.span(m.lastgroup)
        yield Span(start, end, "person_name", 0.2 if _NO_PERSON.search(text[start:end]) else 0.6)


def spans(text: str | None) -> list[Span]:
    """The spans that count, in order and without overlap; the better score wins, then the longer span."""
    if not text:
        return []
    kept: list[Span] = []
    for s in sorted((s for s in propose(text) if s.score >= THRESHOLD), key=lambda s: (-s.score, s.start - s.end, s.start)):
        at = bisect_left(kept, s)
        if (at == 0 or kept[at - 1].end <= s.start) and (at == len(kept) or s.end <= kept[at].start):
            kept.insert(at, s)
    return kept


def redact(text: str | None, found: list[Span]) -> str | None:
    """The text with ``[KIND]`` in place of each span."""
    if not text or not found:
        return text
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


def _over(documents: DataFrame, doc_id: str, text: str, schema: str, rows) -> DataFrame:
    ship(documents.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [r for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in rows(i, t)]
                columns = list(zip(*out)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names)

    return documents.select(doc_id, text).mapInArrow(run, schema)


def _rows_found(i: int, t: str | None) -> list[tuple]:
    return [(i, s.kind, t[s.start : s.end], s.start, s.end) for s in spans(t)]


def _rows_redacted(i: int, t: str | None) -> list[tuple]:
    found = spans(t)
    return [(i, redact(t, found), len(found))]


def find(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, found_text, start_char, end_char): every piece of personal information.

    Null, empty and blank texts hold none. Very long texts are searched whole. Repeated rows
    give repeated results. One pass over the text, no shuffle.
    """
    return _over(documents, doc_id, text, "doc_id bigint, kind string, found_text string, start_char int, end_char int", _rows_found)


def redacted(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, replaced): the texts with typed placeholders, e.g. ``[EMAIL]``; null stays null."""
    return _over(documents, doc_id, text, "doc_id bigint, text string, replaced int", _rows_redacted)
