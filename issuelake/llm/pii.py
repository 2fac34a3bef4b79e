"""Personal information in free text: spans are proposed, confirmed, scored by their context and replaced by typed placeholders."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelake.session import spread

#: A span counts from this score on.
ACCEPT = 0.5
#: The name list is broadcast; a longer one is refused rather than sent.
MOST_NAMES = 20_000
#: Values of a username that name nobody.
FILLERS = {"", "-", "ghost", "unknown", "none", "null", "n/a", "na", "anonymous", "deleted", "someone", "user", "nobody", "test", "guest", "me"}
#: Local parts of addresses that belong to machines.
MACHINES = {"git", "hg", "svn", "noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon", "postmaster", "root", "daemon", "build", "ci", "nobody", "localhost"}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "frau", "herr", "mme", "mlle", "monsieur", "madame", "sr", "sra", "srta", "señor", "señora", "don", "doña", "sir"}

# ---------------------------------------------------------------- validators


def luhn(digits: str) -> bool:
    """The sum of the digits, every second from the right doubled, ends in 0."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return bool(digits) and total % 10 == 0


def mod97(text: str) -> bool:
    """ISO 7064 mod 97-10 over digits and letters (A = 10), check digits last."""
    t = text.upper()
    return t.isalnum() and t.isascii() and int("".join(str(int(c, 36)) for c in t)) % 97 == 1


def mod11_10(digits: str) -> bool:
    """ISO 7064 mod 11,10, the check digit last."""
    p = 10
    for d in digits[:-1]:
        s = (int(d) + p) % 10 or 10
        p = s * 2 % 11
    return len(digits) > 1 and (11 - p) % 10 == int(digits[-1])


def letter23(digits: str, letter: str) -> bool:
    """A control letter chosen by the number modulo 23."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == letter.upper()


def confirmed(value: str) -> bool:
    """Whether any checksum that goes with the form of `value` holds."""
    compact = re.sub(r"[^0-9A-Za-z]", "", value)
    digits = re.sub(r"\D", "", compact)
    if re.fullmatch(r"\d{8}[A-Za-z]", compact):
        return letter23(digits, compact[-1])
    if compact.isdigit():
        return (len(digits) >= 8 and luhn(digits)) or (len(digits) == 11 and mod11_10(digits)) or (len(digits) > 12 and mod97(digits))
    return len(compact) >= 15 and mod97(compact[4:] + compact[:4])


def plausible_phone(text: str) -> bool:
    """Whether the digits fit a numbering plan: an international prefix and 7 to 13 more, a North American number, or a trunk zero and written groups."""
    digits = re.sub(r"\D", "", text)
    if text.lstrip("(").startswith("+"):
        return 8 <= len(digits) <= 15 and digits[0] != "0"
    if digits.startswith("00"):
        return 10 <= len(digits) <= 16 and digits[2] != "0" and bool(re.search(r"\d[ .\-/()]", text))
    if digits.startswith("0"):
        return 9 <= len(digits) <= 12 and bool(re.search(r"\d[ .\-/()]+\d", text))
    plain = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    return len(plain) == 10 and plain[0] in "23456789" and plain[3] in "23456789"


# ----------------------------------------------------------------- proposals

DOMAIN = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}"
LOCAL = r"[\w.+'%-]*[\w+%-]"
QUOTED = r'"[^"\s@][^"\n@]{0,60}"'
EMAIL = re.compile(
    rf"(?P<q>{QUOTED})@{DOMAIN}"
    rf"|(?<![\w.+%$}}-])(?P<p>\w(?:[\w.+'%-]*[\w+-])?)@{DOMAIN}(?![\w-]*\()"
    rf"|(?P<b>{QUOTED}|(?<![\w.+%-])\w(?:[\w.+'%-]*[\w+-])?)\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]+(?:(?:\s?[\[(]\s?dot\s?[\])]\s?|\.)[a-z0-9-]*[a-z0-9])+"
    rf"|(?P<w>{QUOTED}|(?<![\w.+%-])\w(?:[\w.+'%-]*[\w+-])?) at [a-z0-9-]+(?: dot [a-z0-9-]*[a-z0-9])+",
    re.I,
)
DIGITS = r"(?:[ \t\u00a0]?[().\-/]{0,2}[ \u00a0]?\d){6,14}"
PHONE = re.compile(
    rf"(?<![\w+./:=@#-])(?:\+ ?\d|\(\+?\d|\d){DIGITS}(?![\w@])(?!\.\d)(?!-\d)"
    rf"|(?<=tel:)\+?\(?\d{DIGITS}(?!\w)"
    rf"|(?<=[=:\"'])\+?\(?\d{DIGITS}(?![\w.])"
)
PHONE_CUES = re.compile(r"\b(?:tel|telefon|téléphone|teléfono|phone|fone|mobile|mobil|cell|call|ring|sms|fax|whatsapp|urgent|desk|dial|text me|reach|number)\b", re.I)
NOT_PHONE = re.compile(r"\b(?:job|epoch|partition|trace|span|build|port|pid|id|commit|version|offset|order|ticket|request|run|seed|size|bytes|line|timestamp)\s*[:#=]?\s*$|\bvs\s*$", re.I)

LABEL = (
    r"(?:social\s+security|soc\.?\s*sec\.?|ssn|national\s+insurance|nino|ni|national\s+id(?:entity|entification)?|personal\s+(?:id(?:entity|entification)?|code)|citizen|identity\s+card|id\s+card|"
    r"dni|nif|nie|documento(?:\s+nacional)?|tax(?:payer)?\s+id(?:entification)?|tin|steuer[- ]?(?:nummer|id|identifikationsnummer)|steuernr\.?|personalausweis(?:nummer)?|"
    r"reisepass(?:nummer)?|passport|pasaporte|passeport|travel\s+document|driv(?:er'?s?|ing)\s+licen[cs]e|licen[cs]e\s+no\.?|führerschein(?:nummer)?|permis\s+de\s+conduire|num[ée]ro\s+de\s+s[ée]curit[ée]\s+sociale|nir|bsn|cpf|curp|aadhaar|pesel)"
)
ID_NUMBER = re.compile(
    rf"(?<![\w-])(?P<label>{LABEL})(?![a-z])(?:\s+(?:no|nr|num|number|nummer|code|id)\b\.?)?(?P<link>[\s:#=.(\"'>-]*(?:(?:is|was|value|lautet|est|es|number|no\.?)\b[\s:#=(\"']*)?)"
    r"(?P<value>(?=(?:[A-Z]?[ .\-/]?){0,6}\d)[A-Z]{0,2}\d?(?:[ .\-/]?[A-Z0-9]){4,17}(?<![ .\-/]))(?![\w])",
    re.I,
)
ID_VALUE = re.compile(r"(?:[A-Za-z]{1,3}[ -]?)?\d(?:[ .\-/]?\d){4,16}(?:[ -]?[A-Z](?![A-Za-z])|[a-z](?![A-Za-z]))?")
#: Forms with a checksum, found without a label: 8 digits and a control letter, 11 digits in groups or not, account-like codes; and the words that make such a number an identity number, with the characters within which they count.
CHECKED = re.compile(r"(?<![\w.-])(?:\d{8}-?[A-Z]|\d{2} \d{3} \d{3} \d{3}|\d{11}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)(?![\w-])(?!\.\d)")
ID_CUES = re.compile(r"\b(?:identit\w+|identification|identidad|identité|personal(?:ausweis)? (?:id|number|code|nummer)|national (?:id|number)|citizens?|passports?|tax(?:payer)?(?: id| number)|ausweis\w*|social security|residen\w+ (?:card|permit)|iban|bank account)\b", re.I)
NEARBY = 60

CITY = r"[^\W\d_][\w'’-]*(?:[ -](?:sur|sous|am|an der|de|la|le|les|upon|on|[^\W\d_][\w'’-]*)){0,3}?"
BREAK = r"[ \t]*,?[ \t]*(?:\r\n|\r|\n)(?:[ \t]*>)*[ \t]*"
NEXT = rf"(?:,[ \t]*|{BREAK}|,[ \t]+(?:\r\n|\r|\n)?)"
WAYS = r"(?:street|st|road|rd|avenue|ave|lane|ln|court|ct|mews|drive|dr|boulevard|blvd|way|place|pl|square|sq|terrace|close|crescent|row|hill|gardens|park|parkway|alley|wharf)"
UNIT = r"(?:apt|apartment|flat|unit|suite|room|floor)\.?[ ]*#?[ ]*\w{1,5}"
#: Addresses by their beginnings: a house number, a box, or a street name with its number behind.
NUMBERED = re.compile(r"(?<![\w.-])\d{1,5}[a-z]?(?: ?(?:bis|ter))?,? [^\W\d_]", re.I)
BEFORE_NUMBER = re.compile(rf"(?<![\w.-]){UNIT},[ ]*$", re.I)
AFTER_NUMBER = re.compile(
    rf"\d{{1,5}}[a-z]?[ ](?:[^\W\d_][\w'’-]*\.?[ ]){{1,3}}{WAYS}\b\.?(?:,?[ ]*{UNIT})?{NEXT}(?P<city1>{CITY})(?:,?[ ](?:[A-Z]{{2}}[ ])?\d{{4,6}}(?!\d))?(?![\w-])"
    rf"|\d{{1,4}}(?:[ ]?(?:bis|ter))?,?[ ](?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route|calle|avenida|plaza|paseo)[ ](?:de[ ]la[ ]|de[ ]l['’]|du[ ]|des[ ]|de[ ]|d['’]|la[ ]|el[ ])?[^\W\d_][\w'’-]*(?:[ ][^\W\d_][\w'’-]*){{0,3}}?{NEXT}\d{{4,5}}[ ](?P<city2>{CITY})(?![\w-])",
    re.I,
)
BOX = re.compile(rf"(?<![\w.-])p\.?[ ]?o\.?[ ]?box[ ]+\d+{NEXT}(?P<city1>{CITY})(?:[ ]\d{{4,6}}(?!\d))?(?![\w-])", re.I)
STREET_ENDS = ("str. ", "straße ", "strasse ", "weg ", "platz ", "allee ", "gasse ", "ring ", "damm ", "ufer ", "steig ")
STREET = re.compile(rf"(?<![\w.-])[^\W\d_][\w'’-]*?(?:str\.|stra(?:ß|ss)e|weg|platz|allee|gasse|ring|damm|ufer|steig)[ ]\d{{1,4}}[ ]?[a-z]?{NEXT}(?:[A-Z]-)?(?:\d{{4,5}}[ ])?(?P<city1>{CITY})(?![\w-])", re.I)
LABEL_PARTS = ("ssn", "sec", "insur", "nino", "national", "personal", "citizen", "identity", "dni", "nif", "nie", "documento", "tax", "tin", "steuer", "pass", "document", "licen", "führerschein", "permis", "sécurit", "securit", "nir", "bsn", "cpf", "curp", "aadhaar", "pesel")
#: The labels without a part of their own, and the spellings of "at" in brackets.
SHORT_LABELS = re.compile(r"(?<![\w-])(?:ni(?![a-z])|id\s+card)", re.I)
BRACKETED_AT = re.compile(r"[\[(]\s?at\s?[\])]", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
BEFORE_TITLE = re.compile(r"(?<!\w)([^\W\d_]+)\.?[ \t]+$")
BEFORE_INITIAL = re.compile(r"(?<![\w.])[^\W\d_]\.[ \t]+$")
GAP = re.compile(r"[ \t]+(?:[^\W\d_]\.[ \t]+)?|[ \t]*(?:\r\n|\r|\n)[ \t]*")
COMMA = re.compile(r",[ \t]*")
AFTER_INITIAL = re.compile(r"[ \t]+[A-ZÀ-Þ]\.(?!\w)")


class Names:
    """Given and family names: those listed, and those made of a beginning and an ending that several listed names share.

    The list is known to be incomplete. Each listed name is cut where the
    beginning and the ending both occur in most other names; a word that is a
    beginning and an ending with three supporting names or more is taken for a
    name of that part, whatever the length of the list. Names with an
    apostrophe, as O'..., are a listed prefix, a beginning, and an ending that
    some listed name with an apostrophe has.
    """

    def __init__(self, rows: Iterable[tuple[str, str]], support: int = 3):
        self.listed: dict[str, set[str]] = defaultdict(set)
        self.rules: list[tuple[str, frozenset, frozenset, frozenset, frozenset]] = []
        self.known: dict[str, frozenset] = {}
        self.nobody: set[str] = set()
        by_part: dict[str, set[str]] = defaultdict(set)
        for name, part in rows:
            if name and part and name.strip():
                by_part[part].add(name.strip().casefold())
        for part, names in sorted(by_part.items()):
            heads, tails = defaultdict(set), defaultdict(set)
            cuts = lambda w: ((w[:i], w[i:]) for i in range(2, len(w) - 1))
            for w in names:
                self.listed[w].add(part)
                for h, t in cuts(w):
                    heads[h].add(t)
                    tails[t].add(h)
            first, last = defaultdict(int), defaultdict(int)
            for w in sorted(names):
                best = max(cuts(w), key=lambda c: (min(len(heads[c[0]]), len(tails[c[1]])), len(tails[c[1]])), default=None)
                if best:
                    first[best[0]] += 1
                    last[best[1]] += 1
            begin = frozenset(x for x, n in first.items() if n >= support)
            marked = [w.split("'", 1) for w in names if "'" in w]
            behind = frozenset(rest[i:] for _, rest in marked for i in range(2, len(rest) - 1) if rest[:i] in begin) or frozenset(rest[-2:] for _, rest in marked)
            self.rules.append((part, begin, frozenset(x for x, n in last.items() if n >= support), frozenset(p for p, _ in marked), behind))

    def any_of(self, words: list[str]) -> bool:
        """Whether any of these words, case folded, may be a name; words known to be none are passed over together."""
        found = False
        for w in set(words).difference(self.nobody):
            if self.of(w):
                found = True
            elif len(self.nobody) < 1_000_000:
                self.nobody.add(w)
        return found

    def of(self, word: str) -> frozenset:
        """The parts of a name that a word may be."""
        w = word.replace("’", "'").casefold()
        got = self.known.get(w)
        if got is None:
            found = set(self.listed.get(w, ()))
            prefix, mark, rest = w.partition("'")
            for part, begin, end, prefixes, behind in self.rules:
                if mark:
                    made = prefix in prefixes and any(rest[:i] in begin and rest[i:] in behind for i in range(2, len(rest) - 1))
                else:
                    made = any(w[:i] in begin and w[i:] in end for i in range(2, len(w) - 1))
                if made:
                    found.add(part)
            got = frozenset(found)
            if len(self.known) < 1_000_000:
                self.known[w] = got
        return got


def propose_names(text: str, names: Names, taken: Iterable[tuple[int, int]] = ()) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of whole names: two parts in either order, with an initial or a comma, an initial or title with a family name, family names joined by hyphens; nothing within `taken` spans."""
    if not names.any_of(WORD.findall(text.casefold().replace("’", "'"))):
        return
    tokens = [(m.start(), m.end(), p) for m in WORD.finditer(text) if (p := names.of(m.group()))]
    if tokens and taken:
        tokens = [t for t in tokens if all(t[1] <= s or t[0] >= e for s, e in taken)]
    i, n = 0, len(tokens)
    while i < n:
        start, end, part = tokens[i]
        j, score = i, 0.0

        def joined(j: int, end: int) -> tuple[int, int]:
            while j + 1 < n and text[end : tokens[j + 1][0]] == "-" and "family" in tokens[j + 1][2]:
                j, end = j + 1, tokens[j + 1][1]
            return j, end

        if "family" in part:
            j, end = joined(j, end)
        if j + 1 < n:
            gap, other = text[end : tokens[j + 1][0]], tokens[j + 1][2]
            either = ("given" in part and "family" in other) or ("family" in part and "given" in other)
            if either and (m := GAP.fullmatch(gap)) and ("\n" not in gap and "\r" not in gap or "given" in part):
                j, end, score = j + 1, tokens[j + 1][1], 0.9
                j, end = joined(j, end)
            elif "family" in part and "given" in other and COMMA.fullmatch(gap):
                j, end, score = j + 1, tokens[j + 1][1], 0.9
                if m := AFTER_INITIAL.match(text, end):
                    end = m.end()
        before = text[max(0, start - 24) : start]
        if m := BEFORE_INITIAL.search(before):
            start -= len(m.group())
            score = max(score, 0.7 if "family" in part else 0.4)
            before = text[max(0, start - 24) : start]
        if (m := BEFORE_TITLE.search(before)) and m.group(1).casefold() in TITLES:
            score = max(score, 0.8)
        if score:
            yield start, end, score
        i = j + 1


def propose_emails(text: str) -> Iterator[tuple[int, int, float]]:
    for m in EMAIL.finditer(text):
        local = (m["q"] or m["p"] or m["b"] or m["w"]).strip('"').casefold()
        score = 0.9
        if local in MACHINES or local.startswith(("noreply", "no-reply")):
            score -= 0.6
        if text[m.end() : m.end() + 1] == ":" and re.match(r":[\w~./-]", text[m.end() : m.end() + 2]) and local in MACHINES:
            score -= 0.3
        if text[max(0, m.start() - 3) : m.start()] == "://":
            score -= 0.5
        yield m.start(), m.end(), score


def propose_phones(text: str) -> Iterator[tuple[int, int, float]]:
    for m in PHONE.finditer(text):
        value = m.group()
        start, end = m.start(), m.end()
        if value.count("(") < value.count(")"):
            continue
        if value.startswith("(") and value.count("(") > value.count(")"):
            start += 1  # a bracket around the whole number, not around its area code
            value = value[1:]
        before = text[max(0, start - 40) : start]
        before = re.split(r"[\r\n]", before)[-1]
        score = 0.6 if plausible_phone(value) else 0.0
        if score and PHONE_CUES.search(before):
            score += 0.3
        if NOT_PHONE.search(before):
            score -= 0.5
        if re.fullmatch(r"\d{3}[ -]\d{2}[ -]\d{4}|\d{1,3}(?:\.\d{1,3}){3}", value):
            score = 0.0
        if re.fullmatch(r"\d+", value) and len(value) > 11:
            score = 0.0
        yield start, end, score


def propose_ids(text: str) -> Iterator[tuple[int, int, float]]:
    """Numbers behind a label, whatever their checksum; and numbers of a form with a checksum that have none: these count where the checksum holds and a word nearby speaks of identity, and never where it fails."""
    labelled = set()
    for m in ID_NUMBER.finditer(text):
        value = ID_VALUE.search(text, m.start("value"))
        if not value or value.start() != m.start("value"):
            continue
        labelled.add(value.start())
        digits = re.sub(r"\D", "", value.group())
        score = 0.7 if len(digits) >= 6 else 0.3
        if confirmed(value.group()):
            score += 0.2
        if re.search(r"[\r\n]", m["link"]):
            score -= 0.3
        yield value.start(), value.end(), score
    for m in CHECKED.finditer(text):
        if m.start() in labelled or not confirmed(m.group()):
            continue
        score = 0.3
        if ID_CUES.search(text, max(0, m.start() - NEARBY), min(len(text), m.end() + NEARBY)):
            score += 0.3
        if NOT_PHONE.search(text[max(0, m.start() - 24) : m.start()]):
            score -= 0.3
        yield m.start(), m.end(), score


def _address_matches(text: str, low: str) -> Iterator[tuple[int, re.Match]]:
    at = 0
    for n in NUMBERED.finditer(text):
        if n.start() >= at and (m := AFTER_NUMBER.match(text, n.start())):
            at = m.end()
            unit = BEFORE_NUMBER.search(text, max(0, m.start() - 24), m.start())
            yield unit.start() if unit else m.start(), m
    if "box" in low:
        for m in BOX.finditer(text):
            yield m.start(), m
    if any(x in low for x in STREET_ENDS):
        for m in STREET.finditer(text):
            yield m.start(), m


def propose_addresses(text: str, low: str | None = None) -> Iterator[tuple[int, int, float]]:
    for start, m in _address_matches(text, text.lower() if low is None else low):
        found = m.groupdict()
        city = found.get("city1") or found.get("city2") or ""
        score = 0.6
        if re.search(r"\d{4,5}", text[m.end() - 6 : m.end()]) or re.search(r"(?<!\d)\d{4,5} ", text[m.start() + 3 : m.end()]):
            score += 0.2
        if city[:1].islower() and any(c.isupper() for c in text[m.start() : m.start() + 60].split(",")[0]):
            score -= 0.3
        yield start, m.end(), score


def find_spans(text: str, names: Names, username: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, type), in order and without overlaps. `username` is the writer's own, looked for where it is one."""
    proposals = []
    low = text.lower()
    if "@" in low or (" at " in low and " dot " in low) or BRACKETED_AT.search(text):
        proposals += [(s, e, sc, "EMAIL") for s, e, sc in propose_emails(text)]
    proposals += [(s, e, sc, "ADDRESS") for s, e, sc in propose_addresses(text, low)]
    if any(x in low for x in LABEL_PARTS) or SHORT_LABELS.search(text) or ID_CUES.search(low):
        proposals += [(s, e, sc, "ID_NUMBER") for s, e, sc in propose_ids(text)]
    proposals += [(s, e, sc, "PHONE") for s, e, sc in propose_phones(text)]
    proposals += [(s, e, sc, "NAME") for s, e, sc in propose_names(text, names, [p[:2] for p in proposals if p[3] == "EMAIL" and p[2] >= ACCEPT])]
    # a pattern for each row is dear, so it is made only where the name occurs
    if username and username.strip().lower() in low and is_username(username, names):
        for m in re.finditer(rf"(?<![\w-]){re.escape(username.strip())}(?![\w-])(?!@)", text, re.I):
            proposals.append((m.start(), m.end(), 0.8, "HANDLE"))
    rank = {"EMAIL": 0, "ADDRESS": 1, "ID_NUMBER": 2, "PHONE": 3, "NAME": 4, "HANDLE": 5}
    kept: list[tuple[int, int, str]] = []
    for s, e, score, kind in sorted(proposals, key=lambda p: (rank[p[3]], p[0], -p[1])):
        if score >= ACCEPT and all(e <= a or s >= b for a, b, _ in kept):
            kept.append((s, e, kind))
    return sorted(kept)


def is_username(value: str | None, names: Names) -> bool:
    """Whether a reporter value is a username: one word that is neither an address, a name nor a filler."""
    v = (value or "").strip()
    return bool(v) and v.casefold() not in FILLERS and "@" not in v and not re.search(r"\s", v) and not names.of(v)


def username_spans(value: str, names: Names) -> list[tuple[int, int, str]]:
    """Addresses and names in the reporter field; a username itself is not one."""
    return [x for x in find_spans(value, names) if x[2] in ("EMAIL", "NAME")]


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])


SPAN = "array<struct<pii_type:string,start_pos:int,end_pos:int>>"


def scan(records: DataFrame, known_names: DataFrame, id_col: str = "evidence_id", body_col: str = "body", user_col: str = "reporter_username") -> DataFrame:
    """`id_col`, body_spans, user_spans, body_redacted, user_redacted of every row, in one narrow stage.

    Regular expressions propose spans; checksums (Luhn, mod 97, mod 11-10, a
    control letter) and numbering plans confirm; words nearby raise or lower
    the score, and spans of 0.5 or more are kept. A telephone number has to fit
    a numbering plan, an identity number without a label its checksum; behind a
    label a checksum that holds adds to the score, and one that fails takes
    nothing off, since people mistype and mask the numbers that they label. Where kept spans would
    overlap, the order is EMAIL, ADDRESS, ID_NUMBER, PHONE, NAME, HANDLE.
    Positions count code points. Null texts give empty lists and stay null;
    empty ones stay empty; texts are scanned whole. Repeated rows are scanned
    again. Columns beside those named are not read. The name list (name,
    name_part 'given' or 'family') is a fixed list and goes to every task;
    more than MOST_NAMES rows are refused.
    """
    listed = known_names.select("name", "name_part").where("name is not null and name_part is not null").limit(MOST_NAMES + 1).collect()
    if len(listed) > MOST_NAMES:
        raise ValueError(f"the name list has more than {MOST_NAMES} rows")
    pairs = sorted((r[0], r[1]) for r in listed)
    source = spread(records.select(F.col(id_col).alias("k"), F.col(body_col).cast("string"), F.col(user_col).cast("string")))
    kind = source.schema["k"].dataType.simpleString()
    struct = pa.list_(pa.struct([("pii_type", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(pairs)
        as_rows = lambda spans: [{"pii_type": k, "start_pos": s, "end_pos": e} for s, e, k in spans]
        for batch in batches:
            bodies, users = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            in_body = [find_spans(b, names, u) if b else [] for b, u in zip(bodies, users)]
            in_user = [username_spans(u, names) if u else [] for u in users]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(map(as_rows, in_body), struct), pa.array(map(as_rows, in_user), struct),
                    pa.array(map(redacted, bodies, in_body), pa.string()), pa.array(map(redacted, users, in_user), pa.string()),
                ],
                names=[id_col, "body_spans", "user_spans", "body_redacted", "user_redacted"],
            )

    return source.mapInArrow(run, f"`{id_col}` {kind}, body_spans {SPAN}, user_spans {SPAN}, body_redacted string, user_redacted string")


def occurrences(scanned: DataFrame, id_col: str = "evidence_id", body_col: str = "body", user_col: str = "reporter_username") -> DataFrame:
    """One row per span: id, field_name, pii_type, start_pos."""
    spans = F.concat(
        F.transform("body_spans", lambda x: F.struct(F.lit(body_col).alias("field_name"), x["pii_type"].alias("pii_type"), x["start_pos"].alias("start_pos"))),
        F.transform("user_spans", lambda x: F.struct(F.lit(user_col).alias("field_name"), x["pii_type"].alias("pii_type"), x["start_pos"].alias("start_pos"))),
    )
    return scanned.select(id_col, F.explode(spans).alias("x")).select(id_col, "x.field_name", "x.pii_type", "x.start_pos")
