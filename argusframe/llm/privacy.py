"""PII: keyed, type-consistent surrogates.

Entities are found in each text, and each distinct one gets a surrogate from a
keyed hash: of the same type, gender, script and format. The table of distinct
entities is then checked: where two entities share a surrogate, or a surrogate
is itself an entity of the corpus, all but the first draw again, until none
does; later draws are longer where a format has few values. Addresses are
permuted by key within their block instead, and so are the domains of mail and
the mailboxes of a domain among all of their format, since these may be full. Last,
the surrogates are put into the texts that have entities; a person's given and
family names are entities of their own, so that short and full mentions stay
consistent, and a given name's gender is what its mentions in the corpus tell.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of

#: Draws after which a surrogate of a fixed length may equal some other entity of the corpus, but no other surrogate.
FIRST_DRAWS = 12
#: Parts in which the mentions of one entity meet its surrogate.
SALTS = 8

_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)", re.A)
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|\.\d)", re.A)
_CARD = re.compile(r"(?<![\w.+-])[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])", re.A)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)
#: Of addresses that begin with colons, the loopback and those of two groups or more: code has others.
_IP6 = re.compile(
    r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:|:(?::[0-9A-Fa-f]{1,4}){2,7}|::0{0,3}1)(?![\w:]|\.\d)", re.A
)
#: Numbers as they are dialled within a country: a leading zero and groups.
_NATIONAL = re.compile(r"(?<![\w.+/:-])0\d{1,4}[ ./-]\d{2,4}(?:[ .-]?\d{2,5}){1,4}(?![\w-]|\.\d)", re.A)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)
_NAME_WORD = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[А-ЯЁ][а-яё]+|[Α-ΩΆ-Ώ][α-ωά-ώ]+)(?:-(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[А-ЯЁ][а-яё]+))?"
# Forms of address, by the gender that they tell.
_TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Don", "господин", "г-н", "Господин", "κύριος", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Doña", "госпожа", "г-жа", "Госпожа", "κυρία", "Κυρία"),
    "u": ("Dr", "Prof", "Professor", "Doctor"),
}
_GENDER = {t: g for g, ts in _TITLES.items() for t in ts}
# Given names by gender, by which a person without a form of address is known.
GIVEN = {
    "m": (
        "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Peter George Edward Henry Hans Klaus Jürgen Wolfgang Stefan Heinrich Pierre Jacques François "
        "Henri Philippe Carlos Juan José Luis Miguel Pedro Diego Иван Пётр Сергей Андрей Дмитрий Николай Михаил Γιώργος Δημήτρης Νίκος"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Helen Anna Maria Laura Emma Julia Ursula Monika Sabine Petra Ingrid Sophie Marie Claire Camille Isabelle "
        "Juliette Carmen Lucía Sofía Elena Isabel Мария Елена Ольга Наталья Татьяна Μαρία Ελένη"
    ).split(),
}
_TITLE = "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True))
_PERSON = re.compile(rf"(?<!\w)({_TITLE})\.?[  ](?:[A-ZÀ-ÞА-ЯΑ-Ω]\.[  ]?)*({_NAME_WORD})(?:[  ](?:[A-ZÀ-ÞА-ЯΑ-Ω]\.[  ])*({_NAME_WORD}))?")
#: Words by which a text names someone: the two capitalised words after them are a person.
_SAID = re.compile(rf"(?:(?i:\b(?:my name is|signed by|signed|kind regards|best regards|yours sincerely|sincerely|mein name ist|je m'appelle|me llamo|меня зовут))[,:]?\s{{1,3}}|(?m:^)(?:Name|Author|Contact|Employee|Patient)[:=]\s?)({_NAME_WORD})[  ]({_NAME_WORD})")
_CUES = ("name is", "igned", "egards", "incerely", "ame ist", "appelle", "me llamo", "зовут", "Name", "Author", "Contact", "Employee", "Patient")
_NAMED = {g: re.compile(rf"(?<!\w)({'|'.join(map(re.escape, names))})[  ](?:[A-ZÀ-ÞА-ЯΑ-Ω]\.[  ])*({_NAME_WORD})") for g, names in GIVEN.items()}


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _script(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "а" <= c <= "ё" or c == "ё" else "greek" if "ά" <= c <= "ώ" else "latin"


def people_of(text: str) -> Iterator[tuple[str, str, str]]:
    """(gender, given, family) of each mention that tells a person; given may be empty."""
    for m in _PERSON.finditer(text):
        yield _GENDER[m[1]], m[2] if m[3] else "", m[3] or m[2]
    for gender, pattern in _NAMED.items():
        if any(name in text for name in GIVEN[gender]):
            for m in pattern.finditer(text):
                yield gender, m[1], m[2]
    if any(cue in text for cue in _CUES):
        for m in _SAID.finditer(text):
            yield "u", m[1], m[2]


def canonical_ip6(text: str) -> str:
    """The one spelling of an address that has many; empty if it is none."""
    try:
        return str(ipaddress.IPv6Address(text))
    except ValueError:
        return ""


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form), in order and without overlaps; on equal starts the longer wins, then the earlier type.

    The type of a given name ends in the gender that this text tells; the name is one entity whatever that is.
    """
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if any(c.isdigit() for c in text):
        found += [(m.start(), m.end(), "iban", re.sub(" ", "", m[0])) for m in _IBAN.finditer(text) if sum(c.isdigit() for c in m[0]) >= 10]
        found += [(m.start(), m.end(), "card", d) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
        found += [(m.start(), m.end(), "ssn", m[0]) for m in _SSN.finditer(text)]
        found += [(m.start(), m.end(), "ip", m[0]) for m in _IP.finditer(text)]
        found += [(m.start(), m.end(), "phone", d) for p in (_PHONE, _NATIONAL) for m in p.finditer(text) if len(d := _digits(m[0])) >= 8]
    if text.count(":") > 1:
        found += [(m.start(), m.end(), "ip6", v) for m in _IP6.finditer(text) if (v := canonical_ip6(m[0]))]
    people: dict[str, str] = {}
    for gender, given, family in people_of(text):
        if given:
            people.setdefault(given, f"given-{gender}-{_script(given)}")
        ending = "f" if _script(family) == "cyrillic" and family.endswith("а") else "m"
        people.setdefault(family, f"family-{ending}-{_script(family)}")
    if people:
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, people), key=len, reverse=True))})(?!\w)", text):
            kind = people[m[0]]
            found.append((m.start(), m.end(), kind, (m[0][:-1] if kind == "family-f-cyrillic" else m[0]).lower()))
    out, reach = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= reach:
            out.append(x)
            reach = x[1]
    return out


class _Draw:
    """Keyed choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed, self.n, self.pool = f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass"), 0, 0
        self.key, self.left = key, 0

    def below(self, n: int) -> int:
        if self.left < n * n * 64:
            self.pool = int.from_bytes(hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self.left, self.n = 1 << 256, self.n + 1
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out

    def of(self, choices):
        return choices[self.below(len(choices))]

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters of the same case."""
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if "a" <= c <= "z" else chr(65 + self.below(26)) if "A" <= c <= "Z" else c for c in text)


# Parts that invented names are made of, by script.
_SYLLABLES = {
    "latin": ("al", "ber", "cor", "dan", "el", "far", "gil", "hol", "is", "jor", "kel", "lan", "mar", "nor", "os", "per", "quin", "ros", "sel", "tor", "ul", "ver", "wil", "yor"),
    "cyrillic": ("ал", "бор", "вер", "гор", "дан", "ел", "жар", "зор", "иг", "кар", "лан", "мир", "нос", "ол", "пет", "рос", "сел", "тар", "ул", "фед"),
    "greek": ("αλ", "βερ", "γορ", "δαν", "ελ", "ζαν", "ηλ", "θεο", "κορ", "λαν", "μαρ", "νικ", "ορ", "περ", "ρο", "σελ", "τορ", "φιλ"),
}
_ENDINGS = {
    ("given", "m"): {"latin": ("in", "on", "ard", "us"), "cyrillic": ("ан", "ий", "ор"), "greek": ("ος", "ης")},
    ("given", "f"): {"latin": ("a", "ia", "elle", "ina"), "cyrillic": ("а", "ия"), "greek": ("α", "η")},
    ("given", "u"): {"latin": ("y", "e"), "cyrillic": ("я",), "greek": ("ω",)},
    ("family", "m"): {"latin": ("man", "son", "ford", "ley", "ez", "er"), "cyrillic": ("ов", "ев", "ин"), "greek": ("ίδης", "άκης", "όπουλος")},
}


#: First and last address of the blocks within which IPv4 addresses are permuted; all others are one block.
_BLOCKS = [(0, (1 << 24) - 1), (224 << 24, (1 << 32) - 1), (10 << 24, (11 << 24) - 1), (127 << 24, (128 << 24) - 1), ((172 << 24) + (16 << 16), (172 << 24) + (32 << 16) - 1), ((192 << 24) + (168 << 16), (192 << 24) + (169 << 16) - 1)]


def permuted(key: bytes, label: str, x: int, n: int) -> int:
    """x's place in a keyed permutation of 0 to n - 1: a Feistel network, walked until it is back in the range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, max(8, -(-half // 8))

    def round_of(r: int, right: int) -> int:
        out = b""
        while len(out) < size:
            out += hmac.new(key, f"{label}\0{r + 6 * (len(out) // 32)}\0{right}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        return int.from_bytes(out[:size], "big") & mask

    while True:
        left, right = x >> half, x & mask
        for r in range(6):
            left, right = right, left ^ round_of(r, right)
        x = left << half | right
        if x < n:
            return x


def permuted_text(key: bytes, label: str, text: str) -> str:
    """A text of the same format: digits for digits, letters for letters of the same case. No two texts go to one."""
    sizes = [10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1 for c in text]
    form = "".join("0" if n == 10 else c if n == 1 else "a" if c.islower() else "A" for c, n in zip(text, sizes, strict=True))
    bases = [ord("0") if n == 10 else 97 if f == "a" else 65 for f, n in zip(form, sizes, strict=True)]
    x, all_of = 0, 1
    for c, n, b in zip(text, sizes, bases, strict=True):
        x, all_of = x * n + (ord(c) - b if n > 1 else 0), all_of * n
    x, out = permuted(key, f"{label}\0{form}", x, all_of), []
    for c, n, b in zip(reversed(text), reversed(sizes), reversed(bases), strict=True):
        x, k = divmod(x, n)
        out.append(chr(b + k) if n > 1 else c)
    return "".join(reversed(out))


def moved_address(value: str, key: bytes) -> str:
    """An address of the same block; no two addresses move to one."""
    parts = [int(p) for p in value.split(".")]
    x = sum(p << s for p, s in zip(parts, (24, 16, 8, 0), strict=True))
    block = next(((a, b) for a, b in _BLOCKS if a <= x <= b), None)
    if block:
        y = block[0] + permuted(key, f"ip{block[0]}", x - block[0], block[1] - block[0] + 1)
    else:
        y = permuted(key, "ip", x, 1 << 32)
        while any(a <= y <= b for a, b in _BLOCKS):  # the walk leaves out the blocks, and stays a permutation of the rest
            y = permuted(key, "ip", y, 1 << 32)
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


def surrogate(kind: str, value: str, attempt: int, key: bytes, gender: str = "u") -> str:
    """The canonical surrogate of a canonical entity. Draws differ by attempt; those after FIRST_DRAWS are longer where the format allows."""
    d = _Draw(key, kind, value, attempt)
    more = "".join(chr(97 + d.below(26)) for _ in range(attempt // 4))
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        local = d.like(local) + more if attempt else permuted_text(key, f"mailbox\0{domain}", local)
        return f"{local}@{permuted_text(key, f'domain{chr(0)}{top}', host)}.{top}"
    if kind == "ip":
        return moved_address(value, key)
    if kind == "ip6":  # within the block of the first 16 bits
        x, low = int(ipaddress.IPv6Address(value)), (1 << 112) - 1
        return str(ipaddress.IPv6Address(x & ~low | permuted(key, f"ip6{x >> 112}", x & low, low + 1)))
    if kind == "card":
        body = value[0] + "".join(str(d.below(10)) for _ in value[1:])
        if _luhn(value):
            body = next(body[:-1] + str(c) for c in range(10) if _luhn(body[:-1] + str(c)))
        return body
    if kind == "iban":
        body = d.like(value[4:])
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind in ("phone", "ssn"):
        keep = 1 if kind == "phone" else 0  # the first digit tells the country
        any_digit = attempt >= FIRST_DRAWS
        return value[:keep] + "".join(str(1 + d.below(9)) if c.isdigit() and c != "0" and not any_digit else str(d.below(10)) if c.isdigit() else c for c in value[keep:])
    part, *_, script = kind.split("-")
    stem = "".join(d.of(_SYLLABLES[script]) for _ in range(2 + attempt // 4))
    return stem + d.of(_ENDINGS[part, "m" if part == "family" else gender][script])


def dressed(surface: str, kind: str, made: str) -> str:
    """A canonical surrogate in the format of a mention: its grouping, its case, its gender."""
    if kind in ("phone", "card", "iban", "ssn"):
        source = iter(re.sub(r"[^0-9A-Za-z]", "", made))
        return "".join(next(source, "0") if c.isalnum() else c for c in surface)
    if kind == "email":
        return made.upper() if surface.isupper() else "".join(m.upper() if s.isupper() and len(surface) == len(made) else m for s, m in zip(surface.ljust(len(made)), made, strict=False))
    if kind == "ip6":
        return made.upper() if surface.isupper() else made
    if "-" in kind:
        made += "а" if kind == "family-f-cyrillic" else ""
        return made.upper() if surface.isupper() and len(surface) > 1 else made[:1].upper() + made[1:]
    return made


_SPAN = "array<struct<start: int, end: int, kind: string, value: string>>"


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        spans = [[{"start": s, "end": e, "kind": k, "value": v} for s, e, k, v in entities(x)] for x in rows.body]
        yield pd.DataFrame({"body": rows.body, "id": rows.id, "uid": rows.uid, "spans": spans})


def _drawer(key: bytes):
    @F.pandas_udf("string")
    def draw(kind: pd.Series, value: pd.Series, attempt: pd.Series, gender: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, v, int(a), key, g) for k, v, a, g in zip(kind, value, attempt, gender, strict=True)], dtype=object)

    return draw


def _seed() -> Column:
    """The kind that draws: both forms of a family name are one entity, and so is a given name with each gender."""
    return F.regexp_replace(F.regexp_replace("kind", "^family-[mf]-", "family-m-"), "^given-[mfu]-", "given-u-")


def distinct_entities(spans: DataFrame) -> DataFrame:
    """spans: kind, value, repeated or not. Returns kind, value and gender: of a given name, what most of its mentions tell (m if as many tell f)."""
    told = [F.count_if(F.col("kind").startswith(f"given-{g}-")) for g in "mf"]
    gender = F.when(told[0] + told[1] == 0, "u").when(told[0] >= told[1], "m").otherwise("f")
    return spans.withColumn("seed", _seed()).groupBy(F.col("seed").alias("kind"), "value").agg(gender.alias("gender"))


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """entities: distinct kind, value, gender. Adds attempt and made; no two rows share made, whatever their kinds.

    Nor is made a value of the corpus, but for addresses, which are permuted, and numbers that had to draw FIRST_DRAWS times.
    Rows draw until no two share one: every round leaves fewer, as draws grow longer or, for numbers, more values stay free
    than are taken.
    """
    draw = _drawer(key)
    table = entities.withColumn("attempt", F.lit(0))
    table = saved(table.withColumn("made", draw("kind", "value", "attempt", "gender")), "surrogates")
    values = table.where("kind NOT IN ('ip', 'ip6')").select(F.col("value").alias("made")).distinct()
    while True:
        drawn = table.where("kind NOT IN ('ip', 'ip6')")
        first = drawn.groupBy("made").agg(F.min(F.struct("attempt", "kind", "value")).alias("stays"), F.count("*").alias("n"))
        # of those that share, the first stays, which keeps draws in an order that does not loop; of those that copy, none
        shared = first.where("n > 1").select("made", "stays")
        numbers = F.col("kind").isin("phone", "ssn", "card", "iban") & (F.col("attempt") >= FIRST_DRAWS)
        copies = drawn.where(~numbers).join(values, "made", "left_semi").select("kind", "value")
        sharing = drawn.join(shared, "made").where((F.col("kind") != F.col("stays.kind")) | (F.col("value") != F.col("stays.value"))).select("kind", "value")
        bad = saved(sharing.unionByName(copies).distinct(), "surrogates_bad")
        if bad.isEmpty():
            return table
        again = table.join(bad, ["kind", "value"]).withColumn("attempt", F.col("attempt") + 1).withColumn("made", draw("kind", "value", "attempt", "gender"))
        table = saved(table.join(bad, ["kind", "value"], "left_anti").unionByName(again), "surrogates")


def _replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        texts = []
        for body, spans in zip(rows.body, rows.spans, strict=True):
            out, at = [], 0
            for s in sorted(spans, key=lambda s: s["start"]):
                out += [body[at : s["start"]], dressed(body[s["start"] : s["end"]], s["kind"], s["made"])]
                at = s["end"]
            texts.append("".join([*out, body[at:]]))
        yield pd.DataFrame({"id": rows.id, "text": texts, "n_entities": [len(x) for x in rows.spans]})


def surrogated(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text with surrogates, and n_entities of each row of docs. The same key gives the same surrogates for the same corpus.

    A null text counts as empty; each repeated row gives a row, with the same text. A null id stays null. Only texts with
    entities are shuffled. An empty table gives no rows; other columns of docs play no part, whatever their names.
    """
    if not key:
        raise ValueError("a secret key is needed")
    rows = docs.select(text_of(text_column).alias("body"), F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("uid"))
    kind = rows.schema["id"].dataType.simpleString()
    found = saved(rows.mapInPandas(_find, f"body string, id {kind}, uid long, spans {_SPAN}"), "privacy")
    spans = found.select("uid", F.inline("spans"))
    made = surrogates(distinct_entities(spans), key).select(F.col("kind").alias("seed"), "value", "made")
    made = made.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    salted = spans.withColumn("seed", _seed()).withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int"))
    drawn = salted.join(made, ["seed", "value", "salt"]).groupBy("uid").agg(F.collect_list(F.struct("start", "end", "kind", "made")).alias("spans"))
    changed = found.where(F.size("spans") > 0).drop("spans").join(drawn, "uid").mapInPandas(_replace, f"id {kind}, text string, n_entities long")
    return found.where(F.size("spans") == 0).select("id", F.col("body").alias("text"), F.lit(0).cast("long").alias("n_entities")).unionByName(changed)
