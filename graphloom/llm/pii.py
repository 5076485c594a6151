"""PII surrogates: keyed, type-consistent replacements.

Entities (e-mail addresses, phone numbers, IPv4 addresses, card numbers, social
security numbers, IBANs, personal names) are found by pattern.  A name is a given
name of the gazetteer, in title or upper case, or a form of address, and what
follows it: initials, further given names, particles, and a surname, which may be
hyphenated or begin like O'Neil.  In a text with a full name its parts are also
found where they stand alone, if they aren't common words at a sentence's start.

Surrogates are drawn by HMAC under a key: digits for digits, letters for letters,
valid check digits where the original's were valid.  The parts of a name have
surrogates of their own, so "Mr. Smith" and "Mary Smith" go on being related: given
names and initials change places by a keyed cycle within their gender and script,
surnames are spelt anew in their script, with a feminine ending where theirs was.
A surrogate that another entity has, or that is itself an entity of the corpus, is
drawn again (for the later entity in order), so different entities stay different;
equal entities, however they are written, get the same surrogate all over the corpus,
in the format of each place.  Only these redrawn exceptions are looked up for a text,
all other surrogates are computed where it lies.

The key must be given.  The registered query reads it from the setting KEY_SETTING;
without one it draws a random key, once an application.

Defined results: null and empty texts and texts without entities are unchanged, very
long texts are taken whole; entities are the same if their normal forms are (letter
case, and the separators of numbers, don't matter); repeated rows are treated alike;
where patterns overlap the earlier, then the first of the list above counts; an empty
table gives an empty result; further columns pass through, and the new one,
pii_entities (a name counts once), has underscores before it where that name is taken.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets as random_source
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ._cluster import attached, cut, file_key, fresh, text_key

KEY_SETTING = "spark.graphloom.pii.key"

GIVEN = {
    ("latin", "f"): (
        "Mary Anna Maria Emma Olivia Sophia Isabella Julia Laura Sarah Emily Alice Clara Helen Lucy Grace Nora Diana Eva Irene Martha Rosa Sandra Teresa Victoria Susan Linda Karen Nancy Marie "
        "Patricia Jennifer Elizabeth Barbara Jessica Margaret Lisa Betty Dorothy Ashley Kimberly Donna Carol Michelle Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Samantha Katherine Catherine "
        "Christine Christina Rachel Carolyn Janet Virginia Heather Ruth Julie Joyce Charlotte Hannah Abigail Amelia Evelyn Zoe Chloe Fatima Aisha Zainab Khadija Layla Yasmin Noor Priya Anjali Lakshmi Sunita Deepika Pooja Meera Kavita "
        "Carmen Lucia Elena Sofia Ana Pilar Dolores Francesca Giulia Chiara Valentina Paola Camille Claire Sophie Chantal Brigitte Nathalie Isabelle Monique Heike Ingrid Ursula Sabine Petra Monika Claudia Katharina Greta Astrid Freya Sigrid Linnea "
        "Ann Anne Lee Lynn Jane Kate Beth Rosemary Ellen Louise Marlene Joan Gloria Theresa Doris Judith Frances Agnieszka Katarzyna Joanna Magdalena Ewa Beata Zofia Ayse Elif Zeynep Fatma Mei Ying Yuki Sakura Hana Aiko"
    ).split(),
    ("latin", "m"): (
        "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Kevin Brian Edward Peter Henry Carlos Hans Pierre Luis Otto Walter Frank Arthur "
        "Joseph Christopher Donald Joshua Kenneth Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Jack Dennis Jerry Tyler Aaron Jose Adam Nathan Douglas Zachary Kyle Noah Ethan "
        "Jeremy Christian Sean Austin Roger Terry Lawrence Albert Oliver Liam Lucas Oscar Hugo Felix Ahmed Mohammed Muhammad Mohamed Omar Ali Hassan Hussein Ibrahim Yusuf Khalid Tariq Imran Raj Rahul Amit Vijay Sanjay Arjun Ravi Suresh Anil Deepak "
        "Juan Miguel Javier Diego Pablo Fernando Alejandro Antonio Francisco Manuel Rafael Giovanni Marco Luca Matteo Alessandro Giuseppe Jean Jacques Michel Philippe Laurent Nicolas Antoine Guillaume Klaus Jürgen Wolfgang Dieter Günther Stefan Matthias Heinrich Friedrich Karl "
        "Max Leo Sam Ben Dan Tom Tim Joe Jim Bob Ron Ken Ray Roy Carl Fred Harry Philip Philipp Simon Martin Ian Neil Graham Ralph Bruce Wayne Eugene Russell Louis Bobby Johnny Lars Sven Erik Bjorn Magnus Nils Anders Olaf Piotr Krzysztof Andrzej Tomasz Jan Marek Pawel Mehmet Mustafa Emre Hiroshi Kenji Takeshi Haruto Wei Jun"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Анастасия Людмила Галина Валентина Надежда Вера Дарья Ксения Оксана Марина Лариса Полина".split(),
    ("cyrillic", "m"): "Александр Дмитрий Иван Сергей Андрей Михаил Николай Павел Виктор Олег Алексей Владимир Юрий Борис Евгений Игорь Константин Максим Роман Григорий Василий Фёдор".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Γεωργία Βασιλική Δήμητρα Ιωάννα Χριστίνα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Παναγιώτης Βασίλης Γιάννης Χρήστος Θανάσης Σπύρος".split(),
}
#: Names and surnames that are words as well: alone at a sentence's start they aren't taken for names.
WORDS = frozenset("mark grace frank rose young king green white brown hill baker carter walker parker turner wright clark cook black gray fisher hunter mason taylor page price rice long short wood stone field ford bush day may june april hope faith joy jack art will bill rich".split())
_ADDRESS = "(?:(?:Mr|Mrs|Ms|Dr|Prof|Mme|Mlle|Sra?|Sig|г|г-жа)\\.|Mr|Mrs|Ms|Dr|Miss|Herr|Frau|Monsieur|Madame|Señora?|Signora?)"
_OFFICES = "(?:President|Chairman|Chairwoman|Chair|Speaker|Minister|Secretary|Justice|Mayor|Doktor|Professor|Direktor)"


def _any_of(words: list[str]) -> str:
    """A regular expression for these words in which common beginnings are tried once."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def write(at: dict) -> str:
        parts = [re.escape(c) + write(x) for c, x in sorted(at.items()) if c]
        if not parts:
            return ""
        return ("(?:" + "|".join(parts) + ")" if len(parts) > 1 or "" in at else parts[0]) + ("?" if "" in at else "")

    return write(tree)


def _upper_case() -> str:
    """A character class of the capital letters of the Latin, Greek and Cyrillic scripts."""
    out, points = [], [i for i in range(0x530) if chr(i).isupper()]
    for i in points:
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "[" + "".join(chr(a) if a == b else chr(a) + "-" + chr(b) for a, b in out) + "]"


_given = {n.casefold(): kind for kind, names in GIVEN.items() for n in names}
#: In capitals a word is likelier to be a word.
_forms = sorted({n for names in GIVEN.values() for n in names} | {n.upper() for names in GIVEN.values() for n in names if n.casefold() not in WORDS})
_U, _GIV = _upper_case(), _any_of(_forms)
_SUR = f"(?:{_U}['’])?{_U}[^\\W\\d_]+"
_SURS = f"{_SUR}(?:-{_SUR})*"
_PARTICLES = "(?:(?:van|von|vom|der|den|de|del|della|di|da|dos|du|la|le|al|el|bin|ibn|ter|zu|af|av)[ \u00a0])*"
_name = f"(?<!\\w)(?:(?:{_ADDRESS}[ \u00a0])?{_GIV}(?:-{_GIV})?[ \u00a0](?:(?:{_U}\\.|{_GIV})[ \u00a0])*{_PARTICLES}{_SURS}|{_ADDRESS}[ \u00a0](?!{_OFFICES}(?!\\w))(?:{_U}\\.[ \u00a0])*{_PARTICLES}{_SURS})(?!\\w)"
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z])",
    "phone": r"(?<![\w.+(-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d(?:[ .-]?\d){5,13}\d(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])",
    "ip": r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)",
    "card": r"(?<![\w.-])(?:\d{4}[ -]?){3}\d{4}(?![\w-])|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": _name,
}
TYPES = (*(k for k in PATTERNS if k != "name"), "family", "given", "initial")
_any = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_address = re.compile(f"{_ADDRESS}[ \u00a0]")
_piece = re.compile(f"(?:{_U}['’](?={_U}))?([^\\W\\d_]+)(\\.?)")
_alone = re.compile(f"(?<![\\w'’]){_U}[^\\W\\d_]+(?!\\w)")
_sentence = re.compile(r"(?:^|[.!?:\n]['\"”’)]*)\s*$")
#: A superset of the patterns, cheap enough for every text; texts without a match never leave the JVM for detection.
#: Python's digits are those of every script, the JVM's \d is not.
MAYBE = r"@|\p{Nd}(?:\p{Nd}{2}|\.\p{Nd})|\+\p{Nd}(?:[ .-]?\p{Nd}){4}|[A-Z]{2}\p{Nd}{2}|(?=[\p{Lu}г])(?:" + _GIV + r"[- \u00a0]|" + _ADDRESS + r"[ \u00a0])"


def normal(kind: str, raw: str) -> str:
    """The form in which equal entities are equal."""
    if kind in ("email", "family", "given", "initial"):
        return raw.casefold()
    if kind == "iban":
        return raw.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in raw.split("."))
    return re.sub(r"\D", "", raw) if not raw.startswith("+") else "+" + re.sub(r"\D", "", raw)


def _parts(at: int, raw: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, form) of the parts of a name."""
    m = _address.match(raw)
    skip = m.end() if m else 0
    last = max(raw.rfind(" ", skip), raw.rfind("\u00a0", skip), skip - 1) + 1
    for m in _piece.finditer(raw, skip):
        word = m.group(1)
        a, b = m.span(1)
        if a >= last:
            yield at + a, at + b, "family", word.casefold()
        elif m.group(2) and len(word) == 1:
            yield at + a, at + b, "initial", word.casefold()
        elif word.casefold() in _given and word[0].isupper():
            yield at + a, at + b, "given", word.casefold()


def find(text: str | None) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, type, normal form, whether an entity begins here), in order and without overlap; a name is several parts."""
    found: list[tuple[int, int, str, str, bool]] = []
    named: dict[str, str] = {}
    for m in _any.finditer(text) if text else ():
        if m.lastgroup == "name":
            parts = list(_parts(m.start(), m.group()))
            found += [(*p, i == 0) for i, p in enumerate(parts)]
            named.update((form, kind) for _, _, kind, form in parts if kind != "initial")
        else:
            found.append((m.start(), m.end(), m.lastgroup, normal(m.lastgroup, m.group()), True))
    if not named:
        return found
    taken = {i for a, b, *_ in found for i in range(a, b)}
    for m in _alone.finditer(text):
        form = m.group().casefold()
        if form in named and m.start() not in taken and not (form in WORDS and _sentence.search(text, max(0, m.start() - 8), m.start())):
            found.append((m.start(), m.end(), named[form], form, True))
    return sorted(found)


class _Stream:
    """Keyed pseudo-random choices for one entity."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int):
        self.key, self.seed, self.n, self.left = key, f"{kind}\0{form}\0{attempt}".encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.left = self.left[:4], self.left[4:]
        return int.from_bytes(x, "big") % n

    def like(self, text: str) -> str:
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if c.isalpha() else c for c in text)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def script_of(form: str) -> str:
    return next((s for c in form for s, lo, hi in (("greek", 0x370, 0x400), ("cyrillic", 0x400, 0x530)) if lo <= ord(c) < hi), "latin")


_SOUNDS = {"latin": ("aeiou", "bdfgklmnprstvz", "son man berg field well ley ton wood er sen ford stein ini ez dale".split()), "cyrillic": ("аеиоу", "бвгдзклмнпрст", "ов ев ин енко".split()), "greek": ("αεηιο", "βγδκλμνπρστ", "όπουλος ίδης άκης".split())}
_FEMININE = ("ова", "ева", "ёва", "ина")


def _family(form: str, s: _Stream, attempt: int) -> str:
    script = script_of(form)
    vowels, consonants, endings = _SOUNDS[script]
    root = "".join(consonants[s.below(len(consonants))] + vowels[s.below(len(vowels))] for _ in range(2 + attempt // 2)) + consonants[s.below(len(consonants))]
    if form.endswith(_FEMININE):
        return root + _FEMININE[s.below(2)]
    return root + endings[s.below(len(endings))]


@lru_cache(maxsize=32)
def _cycle(key: bytes, names: tuple[str, ...]) -> dict[str, str]:
    """A keyed cycle: each of the names once as another's surrogate."""
    order = sorted(names, key=lambda n: hmac.new(key, ("cycle\0" + n).encode(), hashlib.sha256).digest())
    return dict(zip(order, order[1:] + order[:1]))


_classes = {kind: tuple(n.casefold() for n in names) for kind, names in GIVEN.items()}
_alphabets = tuple(tuple(x) for x in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"))


@lru_cache(maxsize=1 << 14)
def surrogate(kind: str, form: str, key: bytes, attempt: int = 0) -> str:
    """A normal form of the same type for a normal form."""
    if kind == "given":
        return _cycle(key, _classes[_given[form]])[form]
    if kind == "initial":
        return next((_cycle(key, x)[form] for x in _alphabets if form in x), form)
    s = _Stream(key, kind, form, attempt)
    if kind == "family":
        return _family(form, s, attempt)
    if kind == "email":
        local, _, domain = form.partition("@")
        *labels, top = domain.split(".")
        return s.like(local) + "@" + ".".join([*map(s.like, labels[:-1]), labels[-1] if labels[-1] == "example" else s.like(labels[-1])] if labels else []) + "." + top
    if kind == "phone":
        if form.startswith("+"):
            country = 1 if form[1] in "17" else 2
            rest = form[1 + country :]
            return form[: 1 + country] + str(2 + s.below(8)) + s.like(rest[1:])
        return str(2 + s.below(8)) + s.like(form[1:])
    if kind == "ip":
        return ".".join(str(1 + s.below(223 if i == 0 else 254)) for i in range(4))
    if kind == "card":
        body = form[0] + s.like(form[1:-1])
        last = (10 - luhn(body + "0")) % 10
        return body + str(last if luhn(form) == 0 else (last + 1 + s.below(9)) % 10)
    if kind == "ssn":
        area = 1 + s.below(898)
        return f"{area + (area >= 666):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    account = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in form[4:])
    valid = _iban_check(form[:2], form[4:]) == form[2:4]
    check = _iban_check(form[:2], account)
    return form[:2] + (check if valid else f"{(int(check) + 1 + s.below(90)) % 100:02d}") + account


def render(kind: str, raw: str, form: str) -> str:
    """The surrogate's normal form in the format of the original at this place."""
    if kind == "ip":
        return form
    if kind in ("family", "given", "initial"):
        return form.upper() if raw.isupper() else form[:1].upper() + form[1:] if raw[:1].isupper() else form
    if kind == "email":
        return form.upper() if raw.isupper() else form if len(form) != len(raw) else "".join(n.upper() if o.isupper() else n for n, o in zip(form, raw))
    chars = iter(form.lstrip("+"))
    return "".join(next(chars) if o.isalnum() else o for o in raw)


def replace(text: str, key: bytes, redrawn: dict[tuple[str, str], int]) -> tuple[str, int]:
    """(text with surrogates, entities), given the attempts of the entities that were drawn again."""
    parts, at, n = [], 0, 0
    for a, b, kind, form, begins in find(text):
        parts += [text[at:a], render(kind, text[a:b], surrogate(kind, form, key, redrawn.get((kind, form), 0)))]
        at, n = b, n + begins
    return "".join([*parts, text[at:]]), n


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, th, file, kind, form): the distinct entities of each text whose surrogates could collide."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, h, o, k, f) for i, h, o, t in zip(*(c.to_pylist() for c in batch.columns)) for k, f in sorted({x[2:4] for x in find(t) if x[2] not in ("given", "initial")})]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "th", "file", "kind", "form"])

    maybe = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), file_key().alias("file"), "text").where(F.col("text").rlike(MAYBE))
    return maybe.mapInArrow(make, "doc_id long, th long, file long, kind string, form string")


def _draw(table: DataFrame, key: bytes) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, form, attempt = (batch.column(i).to_pylist() for i in range(3))
            new = pa.array([surrogate(k, f, key, a) for k, f, a in zip(kind, form, attempt)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], new], ["kind", "form", "attempt", "new"])

    return table.select("kind", "form", "attempt").mapInArrow(make, "kind string, form string, attempt int, new string")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, attempt, new) for each distinct entity: no two alike, none of them an entity itself."""
    distinct = cut(found.select("kind", "form").distinct())
    originals = distinct.select("kind", F.col("form").alias("new"), F.lit(True).alias("real"))
    table = cut(_draw(distinct.withColumn("attempt", F.lit(0)), key))
    while True:
        # of entities with one surrogate the one drawn least often, then least in order, keeps it
        owner = table.groupBy("kind", "new").agg(F.min_by("form", F.struct("attempt", "form")).alias("owner"), F.count("*").alias("n"))
        clash = owner.join(originals, ["kind", "new"], "left").where("n > 1 OR real")
        again = cut(table.join(clash, ["kind", "new"]).where("real OR form <> owner").select("kind", "form", (F.col("attempt") + 1).alias("attempt")))
        if again.isEmpty():
            return table
        table = cut(table.join(again.select("kind", "form"), ["kind", "form"], "left_anti").unionByName(_draw(again, key)))


_drawn_keys: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key of the setting KEY_SETTING, or a random one for this application."""
    own = spark.conf.get(KEY_SETTING, None)
    return own.encode() if own else _drawn_keys.setdefault(spark.sparkContext.applicationId, random_source.token_bytes(32))


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """docs, all columns, texts with surrogates, and pii_entities, how many were replaced."""
    if not key:
        raise ValueError("surrogates need a key")
    found = cut(entities(docs))
    redrawn = found.join(assign(found, key).where("attempt > 0").select("kind", "form", "attempt"), ["kind", "form"])
    side = cut(redrawn.groupBy("doc_id", "th", "file").agg(F.collect_list(F.struct("kind", "form", "attempt")).alias("value")))
    n, size = side.agg(F.count("*"), F.coalesce(F.sum(F.size("value")), F.lit(0))).first()
    known_, maybe_, count_ = (fresh(docs, x)[0] for x in ("_known", "_maybe", "pii_entities"))
    columns = docs.columns
    rows = attached(docs, side, n * 64 + size * 100, known_).withColumn(maybe_, F.coalesce(F.col("text").rlike(MAYBE), F.lit(False)))
    schema = S.StructType([*docs.schema, S.StructField(count_, S.IntegerType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, last = columns.index("text"), len(columns)
            arrays, counts = list(batch.columns[:last]), [0] * batch.num_rows
            some = [i for i, x in enumerate(batch.column(last + 1).to_pylist()) if x]
            if some:
                texts, known = arrays[where].to_pylist(), batch.column(last)
                for i in some:
                    texts[i], counts[i] = replace(texts[i], key, {(e["kind"], e["form"]): e["attempt"] for e in known[i].as_py() or ()})
                arrays[where] = pa.array(texts, batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int32())], [*columns, count_])

    return rows.mapInArrow(make, schema)
