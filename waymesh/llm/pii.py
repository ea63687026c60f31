"""Surrogates for personal data: keyed, of the same type, gender, script and format, and distinct.

1. Every text is scanned for e-mail addresses, telephone, card, account, social security, IPv4 and IPv6 numbers, and names
   after a title; a name found so is found wherever it stands capitalised in the same text. Each finding is an entity: a
   kind and a canonical value, so that "+1 (017) 555-7713" and "+10175557713", or "Mr Ward", "Ward" and "MR WARD", are one.
2. Each distinct entity gets a surrogate from a keyed function. For numbers and addresses it is a keyed permutation of
   the strings of one format, so equal formats can't collide, with valid check digits where the original's were; names are
   put together from syllables by gender and script, in as many as the corpus needs.
3. Collisions are looked for over the whole corpus: two entities with one surrogate, a surrogate that is some real
   entity, an entity that maps to itself. One of the claimants keeps it, the others draw again, for ROUNDS_OF_DRAWS
   rounds. What is left then, where the real entities fill most of their format, changes places among itself.
4. The map returns to the documents by a join on the entity, and every place found is written in its own format.

Entities are aggregated before each shuffle; a hot entity is one row in the map and its join may be split. Texts are scanned
once; they are shuffled once, by document, to where their places are.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymesh.llm.common import cut, documents, id_type, with_text_hash
from waymesh.session import with_dense_ids

KEY = b"waymesh-surrogates"  # a default for tests; give a secret key of your own
ROUNDS = 8
ROUNDS_OF_DRAWS = 12

#: Titles by gender, and names by gender and script.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("m", "latin"): ("adam", "alan", "bruno", "carl", "david", "emil", "felix", "georg", "hugo", "ivan", "jonas", "karl", "louis", "martin", "nils", "oscar", "paul", "robert", "simon", "thomas", "victor", "walter"),
    ("f", "latin"): ("alice", "anna", "bertha", "clara", "diana", "elena", "emma", "flora", "greta", "helen", "irene", "julia", "karin", "laura", "maria", "nora", "olga", "paula", "rosa", "sofia", "teresa", "vera"),
    ("m", "cyrillic"): ("алексей", "борис", "виктор", "григорий", "дмитрий", "иван", "максим", "николай", "павел", "сергей"),
    ("f", "cyrillic"): ("анна", "вера", "галина", "дарья", "елена", "ирина", "мария", "наталья", "ольга", "татьяна"),
    ("m", "greek"): ("ανδρέας", "γιώργος", "δημήτρης", "ηλίας", "κώστας", "νίκος", "πέτρος", "στέφανος"),
    ("f", "greek"): ("άννα", "βασιλική", "ελένη", "ζωή", "ιωάννα", "κατερίνα", "μαρία", "σοφία"),
}
SURNAMES = {
    "latin": ("abel", "bauer", "carter", "dubois", "ellis", "fischer", "garcia", "hughes", "jansen", "keller", "lambert", "moreno", "nielsen", "olsen", "perez", "quinn", "richter", "santos", "turner", "vidal", "wagner", "young"),
    "cyrillic": ("белов", "волков", "громов", "зайцев", "козлов", "лебедев", "морозов", "новиков", "орлов", "соколов"),
    "greek": ("αλεξίου", "γεωργίου", "δημητρίου", "ιωάννου", "κωνσταντίνου", "νικολάου", "παππάς", "σταύρου"),
}
#: What names are put together from. Onsets and vowels make syllables; the ending tells gender.
ONSETS = {
    "latin": ("b", "br", "c", "d", "dr", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "st", "t", "v", "w"),
    "cyrillic": ("б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "ф", "х"),
    "greek": ("β", "γ", "δ", "ζ", "θ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ", "φ", "χ"),
}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειοω"}
ENDINGS = {
    ("given", "m", "latin"): ("an", "en", "in", "or", "us"), ("given", "f", "latin"): ("a", "ia", "ina"),
    ("given", "m", "cyrillic"): ("ан", "ей", "ил", "ор"), ("given", "f", "cyrillic"): ("а", "ина", "ия"),
    ("given", "m", "greek"): ("ας", "ης", "ος"), ("given", "f", "greek"): ("α", "η", "ία"),
    ("surname", "m", "latin"): ("er", "ley", "man", "son", "ton"), ("surname", "f", "latin"): ("er", "ley", "man", "son", "ton"),
    ("surname", "m", "cyrillic"): ("ев", "ин", "ов"), ("surname", "f", "cyrillic"): ("ева", "ина", "ова"),
    ("surname", "m", "greek"): ("άκης", "ίδης", "όπουλος"), ("surname", "f", "greek"): ("άκη", "ίδου", "οπούλου"),
}
#: Letters in which given names of women end.
FEMININE = {"latin": "a", "cyrillic": "ая", "greek": "αηάή"}
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")

_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁΆ-Ώ][\w'’-]*"
_SPELLED = sorted({x for titles in TITLES.values() for t in titles for x in (t, t.upper())}, key=lambda t: (-len(t), t))
_GENDER = {t.lower(): g for g, titles in TITLES.items() for t in titles}
_HEX = "0123456789abcdef"
_WORD = re.compile(r"[\w'’-]+")
_MONTH, _DAY = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_DATE = re.compile(rf"(?:(?:19|20)\d\d[-./ ]{_MONTH}[-./ ]{_DAY}|{_DAY}[-./ ]{_MONTH}[-./ ](?:19|20)\d\d)(?:[-. ]\d{{1,2}}){{0,3}}")
_VERSION = re.compile(r"(?i)\b(?:version|release|build|firmware|chapter|section)\s*$")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERN = re.compile(
    "|".join(
        (
            r"(?P<email>[\w.%+-]+@(?:[\w-]+\.)+[A-Za-z]{2,})",
            rf"(?P<person>\b(?:{'|'.join(map(re.escape, _SPELLED))})\b\.?[ \t]+{_CAPITAL}(?:[ \t]+{_CAPITAL}){{0,2}})",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<ipv6>(?<![\w:.])(?=[\dA-Fa-f:]*:[\dA-Fa-f:]*:)[\dA-Fa-f:]{3,39}(?![\w:]))",
            rf"(?P<ipv4>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]))",
            r"(?P<phone>(?<![\w+])(?:\+\d{7,15}|\+?(?:\d{1,3}[ .-])?(?:\(\d{2,4}\)[ .-]?|\d{2,5}[ .-])\d{2,4}(?:[ .-]\d{2,4}){1,4})(?![\w]))",
        )
    )
)
_HINT = re.compile(rf"[@\d]|::|\b(?:{'|'.join(map(re.escape, _SPELLED))})\b")


# -- detection ------------------------------------------------------------------------------------------------------


def script_of(word: str) -> str:
    for c in word:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῾":
            return "greek"
    return "latin"


def _gender_of(given: str, script: str) -> str:
    """Of a given name whose title doesn't say: from the lists, else by its ending."""
    return next((g for g in "mf" if given in GIVEN[g, script]), "f" if given[-1] in FEMININE[script] else "m")


def _name_parts(match: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of each name after the title. The last one is the surname."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(match)]
    gender = _GENDER[match[words[0][0] : words[0][1]].lower()]
    names = words[1:]
    out = []
    for i, (a, b) in enumerate(names):
        word = match[a:b].lower()
        script = script_of(word)
        if i == len(names) - 1:
            out.append((a, b, f"surname/{script}", word))
        else:
            out.append((a, b, f"given/{_gender_of(word, script) if gender == 'n' else gender}/{script}", word))
    return out


def _ipv6(raw: str) -> str | None:
    try:
        return str(ipaddress.IPv6Address(raw))
    except ValueError:
        return None


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of every entity, in order."""
    if not text or not _HINT.search(text):
        return []
    out = []
    for m in PATTERN.finditer(text):
        kind, raw, at = m.lastgroup, m.group(), m.start()
        if kind == "person":
            out += [(at + a, at + b, k, v) for a, b, k, v in _name_parts(raw)]
        elif kind == "email":
            out.append((at, m.end(), kind, raw.lower()))
        elif kind == "iban":
            out.append((at, m.end(), kind, raw.replace(" ", "")))
        elif kind == "ipv6":
            if (address := _ipv6(raw)) is not None and re.search(r"\d|[A-Fa-f]{2}", raw):
                out.append((at, m.end(), kind, address))
        elif kind == "ipv4":
            if not _VERSION.search(text, max(0, at - 20), at):
                out.append((at, m.end(), kind, ".".join(str(int(x)) for x in raw.split("."))))
        else:
            digits = re.sub(r"\D", "", raw)
            if kind == "phone" and (not 7 <= len(digits) <= 15 or _DATE.fullmatch(raw)):
                continue
            out.append((at, m.end(), kind, digits))
    names: dict[str, str] = {}
    for _, _, kind, value in out:
        if kind.startswith(("given/", "surname/")) and len(value) > 1:
            names.setdefault(value, kind)
    if names:
        taken = iter([*out, (len(text) + 1, len(text) + 1, "", "")])
        a, b, *_ = next(taken)
        more = []
        for m in _WORD.finditer(text):
            while m.start() >= b:
                a, b, *_ = next(taken)
            if m.end() > a or not m.group()[0].isupper():
                continue
            word = m.group()
            for suffix in ("", "'s", "’s"):
                bare = word[: len(word) - len(suffix)]
                if word.endswith(suffix) and (kind := names.get(bare.lower())) and (bare.isupper() or bare[1:] == bare[1:].lower()):
                    more.append((m.start(), m.start() + len(bare), kind, bare.lower()))
                    break
        out = sorted(out + more)
    return out


# -- surrogates -----------------------------------------------------------------------------------------------------


def _stream(key: bytes, *parts: object) -> Iterator[int]:
    """Bytes from a keyed hash of parts."""
    seed = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
    n = 0
    while True:
        yield from hmac.new(key, seed + b"\x1e%d" % n, hashlib.sha256).digest()
        n += 1


def _draw(stream: Iterator[int], below: int) -> int:
    return int.from_bytes([next(stream) for _ in range(8)], "big") % below


def permute(key: bytes, text: str, tweak: object) -> str:
    """A keyed permutation of the strings that agree with text in length, in each character's alphabet and in all
    characters outside the alphabets: a Feistel network whose halves are every other character."""
    alphabet = [next((a for a in ALPHABETS if c in a), None) for c in text]
    places = [i for i, a in enumerate(alphabet) if a]
    shape = "".join(str(ALPHABETS.index(a)) if a else c for a, c in zip(alphabet, text))
    digits = {i: alphabet[i].index(text[i]) for i in places}
    halves = (places[0::2], places[1::2])
    for r in range(ROUNDS):
        mine, other = halves[r % 2], halves[1 - r % 2]
        stream = _stream(key, "permute", tweak, shape, r, [digits[i] for i in other])
        for i in mine:
            digits[i] = (digits[i] + _draw(stream, len(alphabet[i]))) % len(alphabet[i])
    return "".join(alphabet[i][digits[i]] if i in digits else c for i, c in enumerate(text))


def luhn_digit(digits: str) -> str:
    """The check digit that follows digits."""
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_checks(country: str, body: str) -> str:
    """The two check digits."""
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02d}"


def made_name(key: bytes, kind: str, value: str, attempt: int) -> str:
    """A name of the same gender and script from syllables, of two at first and one more every third attempt."""
    part, *_, script = kind.split("/")
    gender = kind.split("/")[1] if part == "given" else "f" if value[-1] in FEMININE[script] or value.endswith("ου") else "m"
    stream = _stream(key, "name", kind, attempt, value)
    pick = lambda of: of[_draw(stream, len(of))]
    syllables = "".join(pick(ONSETS[script]) + pick(VOWELS[script]) for _ in range(1 + attempt // 3))
    return syllables + pick(ONSETS[script]) + pick(ENDINGS[part, gender, script])


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The candidate for an entity; another one for each attempt."""
    tweak = (kind, attempt)
    if kind == "email":
        name, _, domain = value.rpartition("@")
        labels, _, top = domain.rpartition(".")
        return f"{permute(key, name, (*tweak, domain))}@{permute(key, labels, 'domain')}.{top}"
    if kind == "ipv4":
        number = 0
        for part in value.split("."):
            number = number << 8 | int(part)
        for r in range(ROUNDS):
            high, low = number >> 16, number & 0xFFFF
            number = low << 16 | high ^ _draw(_stream(key, tweak, r, low), 1 << 16)
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ipv6":
        number = int(ipaddress.IPv6Address(value))
        for r in range(ROUNDS):
            high, low = number >> 64, number & (1 << 64) - 1
            number = low << 64 | high ^ int.from_bytes([b for b, _ in zip(_stream(key, tweak, r, low), range(8))], "big")
        return str(ipaddress.IPv6Address(number))
    if kind == "card" and luhn_digit(value[:-1]) == value[-1]:
        body = permute(key, value[:-1], tweak)
        return body + luhn_digit(body)
    if kind == "iban":
        body = permute(key, value[4:], tweak)
        valid = iban_checks(value[:2], value[4:]) == value[2:4]
        return value[:2] + (iban_checks(value[:2], body) if valid else permute(key, value[2:4], (*tweak, "checks"))) + body
    if kind.startswith(("given/", "surname/")):
        if attempt == 0:
            names = SURNAMES[kind.split("/")[1]] if kind.startswith("surname") else GIVEN[tuple(kind.split("/")[1:])]
            return names[_draw(_stream(key, tweak, value), len(names))]
        return made_name(key, kind, value, attempt)
    return permute(key, value, tweak)


def in_format(raw: str, kind: str, new: str) -> str:
    """new, written the way raw is: its separators, its capitals."""
    if kind.startswith(("given/", "surname/")):
        return new.upper() if raw.isupper() and len(raw) > 1 else new[:1].upper() + new[1:] if raw[:1].isupper() else new
    if kind == "email":
        return "".join(c.upper() if i < len(raw) and raw[i].isupper() else c for i, c in enumerate(new)) if len(raw) == len(new) else new.upper() if raw.isupper() else new
    if kind == "ipv6":
        new = new if "::" in raw or len(raw) < 20 else ipaddress.IPv6Address(new).exploded
        return new.upper() if raw.upper() == raw and raw.lower() != raw else new
    if kind == "ipv4":
        return new
    chars = iter(new)
    return "".join(next(chars, "") if c.isalnum() else c for c in raw)


def replace(text: str, places: list[tuple[int, int, str, str]]) -> str:
    """text with a surrogate at each place: (start, end, kind, new), in order."""
    out, done = [], 0
    for a, b, kind, new in places:
        out += [text[done:a], in_format(text[a:b], kind, new)]
        done = b
    return "".join([*out, text[done:]])


# -- the corpus -----------------------------------------------------------------------------------------------------


def _finder(id_arrow: pa.DataType):
    """A row for each entity of a text, with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    places: dict[tuple[str, str], list[dict]] = {}
                    for a, b, kind, value in find(text):
                        places.setdefault((kind, value), []).append({"a": a, "b": b})
                    rows += [(i, kind, value, p) for (kind, value), p in places.items()]
                pick, kinds, values, spans = zip(*rows) if rows else ((), (), (), ())
                pick = pa.array(pick, pa.int64())
                yield pa.record_batch(
                    [part.column("doc_id").take(pick).cast(id_arrow), part.column("th").take(pick), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                    ["doc_id", "th", "kind", "value", "places"],
                )

    return run


def _drawer(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = batch.column("kind").to_pylist(), batch.column("value").to_pylist()
            new = [surrogate(key, k, v, attempt) for k, v in zip(kinds, values)]
            yield pa.record_batch([batch.column("kind"), batch.column("value"), pa.array(new, pa.string())], ["kind", "value", "new"])

    return run


def _shape(value: Column) -> Column:
    """Digits and letters by their kind: values of one shape can stand for each other."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), r"\p{Lu}", "A"), r"\p{Ll}", "a")


def _exchanged(left: DataFrame, key: bytes) -> DataFrame:
    """left: (kind, value). (kind, value, new): each value's place is taken by the next one of its kind and shape, in an order
    that the key decides; the last one's by the first. A value that is alone keeps itself as new."""
    keyed = left.select("kind", "value", _shape(F.col("value")).alias("shape"), F.sha2(F.concat(F.lit(key.hex()), F.col("value")), 256).alias("at"))
    ranked = cut(with_dense_ids(keyed, "kind", "shape", "at", name="n"))
    following = ranked.select(F.col("kind").alias("k2"), F.col("shape").alias("s2"), F.col("value").alias("next"), (F.col("n") - 1).alias("n2"))
    first = ranked.groupBy(F.col("kind").alias("k3"), F.col("shape").alias("s3")).agg(F.min_by("value", "n").alias("first"))
    both = ranked.join(following, (F.col("n") == F.col("n2")) & (F.col("kind") == F.col("k2")) & (F.col("shape") == F.col("s2")), "left")
    return both.join(first, (F.col("kind") == F.col("k3")) & (F.col("shape") == F.col("s3"))).select("kind", "value", F.coalesce("next", "first").alias("new"))


def assign(entities: DataFrame, key: bytes = KEY, most_rounds: int = ROUNDS_OF_DRAWS) -> DataFrame:
    """entities: distinct (kind, value). (kind, value, new), where within a kind no new value is given twice and none is the
    entity itself. No new value is any entity's value, but where most_rounds draws found none free for some entities (they
    fill most of their format, such as all telephone numbers of seven digits): those exchange their values."""
    real = entities.select(F.col("kind").alias("rk"), F.col("value").alias("rv"))
    taken, left = None, entities
    for attempt in range(most_rounds):
        drawn = left.mapInArrow(_drawer(key, attempt), "kind string, value string, new string")
        free = drawn.join(real, (F.col("kind") == F.col("rk")) & (F.col("new") == F.col("rv")), "left_anti")
        if taken is not None:
            used = taken.select(F.col("kind").alias("uk"), F.col("new").alias("un"))
            free = free.join(used, (F.col("kind") == F.col("uk")) & (F.col("new") == F.col("un")), "left_anti")
        won = free.groupBy("kind", "new").agg(F.min_by("value", F.struct(F.xxhash64("value"), "value")).alias("value")).select("kind", "value", "new")
        taken = cut(won if taken is None else taken.unionByName(won))
        have = taken.select(F.col("kind").alias("hk"), F.col("value").alias("hv"))
        left = cut(entities.join(have, (F.col("kind") == F.col("hk")) & (F.col("value") == F.col("hv")), "left_anti"))
        if left.isEmpty():
            return taken
    given = cut(_exchanged(left, key))
    done, alone = given.filter("new <> value"), given.filter("new = value")
    if not alone.isEmpty():
        # A value that is the only one of its shape left takes over some other entity's surrogate, which gets its value.
        donor = taken.select("kind", F.col("value").alias("dv"), F.col("new").alias("dn"), _shape(F.col("value")).alias("shape")).groupBy("kind", "shape").agg(F.min(F.struct("dv", "dn")).alias("d"))
        pairs = cut(alone.select("kind", "value", _shape(F.col("value")).alias("shape")).join(donor, ["kind", "shape"], "left"))
        lent = pairs.filter("d is not null")
        moved = lent.select(F.col("kind").alias("mk"), F.col("d.dv").alias("mv"))
        taken = taken.join(moved, (F.col("kind") == F.col("mk")) & (F.col("value") == F.col("mv")), "left_anti")
        swapped = lent.select("kind", "value", F.col("d.dn").alias("new")).unionByName(lent.select("kind", F.col("d.dv").alias("value"), F.col("value").alias("new")))
        # And one whose shape no other entity has can't keep it.
        other = pairs.filter("d is null").select("kind", "value", F.concat(F.lit("x"), F.substring(F.sha2(F.concat(F.lit(key.hex()), F.col("value")), 256), 1, 24)).alias("new"))
        done = done.unionByName(swapped).unionByName(other)
    return cut(taken.unionByName(done))


def _writer(id_arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, counts, entities = [], [], []
                for text, known in zip(part.column("text").to_pylist(), part.column("known").to_pylist()):
                    places = sorted((p["a"], p["b"], k["kind"], k["new"]) for k in known or () for p in k["places"])
                    texts.append(replace(text, places) if places else text)
                    counts.append(len(places))
                    entities.append(len(known or ()))
                yield pa.record_batch([part.column("doc_id").cast(id_arrow), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(entities, pa.int64())], ["doc_id", "text", "n_replaced", "n_entities"])

    return run


def pseudonymise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """One row per input row: doc_id, text (with surrogates), n_replaced (occurrences), n_entities (distinct ones).

    A name stands for a person within its kind: given names by gender, and surnames. Names without a title anywhere in the
    text aren't found. Null text becomes empty; texts without entities stay as they are. Null ids are allowed, repeated rows each get their
    row, an empty table gives an empty result. Columns beyond id and text are ignored. The same key gives the same
    surrogates as long as the set of entities, which decides collisions, is the same.
    """
    docs = with_text_hash(documents(df, id_col, text_col))
    kind = id_type(df, id_col)
    found = cut(docs.mapInArrow(_finder(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, th long, kind string, value string, places array<struct<a:int,b:int>>"))
    given = assign(cut(found.select("kind", "value").distinct()), key).select(F.col("kind").alias("gk"), F.col("value").alias("gv"), "new")
    known = found.join(given, (F.col("kind") == F.col("gk")) & (F.col("value") == F.col("gv"))).groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set(F.struct("kind", "value", "new", "places")).alias("known"))
    both = docs.join(known, docs.doc_id.eqNullSafe(known["__id"]) & (docs.th == known["__th"]), "left").select("doc_id", "text", "known")
    return both.mapInArrow(_writer(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, text string, n_replaced long, n_entities long")
