"""Personal data and secrets replaced by keyed surrogates of the same type, script and format.

Entities are found by patterns. Each type says which positions of an entity may change and among which characters. The
permutable positions of one format make a finite domain; a keyed Feistel network P permutes it, and the surrogate of x is
``P^-1(P(x) + 1)``. That map is a bijection without fixed points, so within a format different entities get different
surrogates, no entity stays as it was, and equal entities get equal surrogates in every document, without any table of
entities and without a shuffle. ``collisions`` checks that distinctness over a whole result.

What is permuted is a normalised value: the digits of a phone, card or IBAN, the letters of an address or name without case.
The entity's own format is put on again, so one entity written in several ways gets one surrogate written in those ways. A
word of a name found in a text is replaced wherever it stands alone in that text. Where values of one place look like
several kinds (digits, hexadecimal digits, known forms of keys, other values; valid and invalid IBANs), each kind is mapped
onto itself, so no two kinds meet. Entities of any length are cut into blocks of ``BLOCK`` characters, each permuted under
a label that holds a digest of the blocks before it: still a bijection, in linear time.

Kept: length, punctuation and country code of phones; validity of check digits (cards, IBANs) and the class of an address
(private, loopback, link-local, public); the case and script of letters; gender and script of listed given names. A title in
front of a name stays and gives its gender.

Defined results: null text stays null, empty text stays empty, neither has entities; repeated rows get equal results; an
empty table gives an empty one; whole texts are read whatever their length; ``with_surrogates`` carries all other columns along.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from seqloom.llm.common import pinned, spare

SLICE, BLOCK = 512, 48
#: Given names by script and gender.
GIVEN = {
    ("latin", "female"): "Alice Anna Barbara Clara Diana Elena Emma Eva Hannah Helen Irene Julia Laura Linda Lucy Maria Martha Mary Nina Olivia Paula Rose Sarah Sophia".split(),
    ("latin", "male"): "Adam Albert Bruno Carl Daniel David Edward Felix George Henry Hugo James John Karl Louis Martin Max Oscar Paul Peter Robert Simon Thomas Victor".split(),
    ("cyrillic", "female"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "male"): "Алексей Борис Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    ("greek", "female"): "Αννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "male"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
#: Titles and the gender they give.
TITLES = {"Mr": "male", "Mrs": "female", "Ms": "female", "Miss": "female", "Herr": "male", "Frau": "female", "Monsieur": "male", "Madame": "female", "Señor": "male", "Señora": "female", "Dr": "", "Prof": ""}
#: Letters that may stand for each other (vowels for vowels, and so on).
ALPHABETS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "äöü", "âêîôû", "0123456789",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
)
ALPHABETS += tuple(a.upper() for a in ALPHABETS if a.upper() != a)
CLASS_OF = {c: a for a in ALPHABETS for c in a}
DIGITS, HEX, MARKS = "0123456789", "0123456789abcdef", "!#$%&*+-./:;<=>?@^_~"
NAMES = {n: (list_, gender) for (_, gender), list_ in GIVEN.items() for n in list_}
EXACT = {n.lower(): n for n in NAMES}
#: Country codes of one and two digits; all others have three.
COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|\d*")

_title = "|".join(sorted(TITLES, key=len, reverse=True))
_name = "|".join(sorted(NAMES, key=len, reverse=True))
_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_hextet = r"[0-9A-Fa-f]{1,4}"
_surname = r"[^\W\d_a-zà-ÿа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
_secret = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}"
PATTERNS = (
    ("email", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("secret", rf"(?<!\w)(?:{_secret})(?!\w)"),
    ("assigned", r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*["'])[^"'\s]{6,}(?=["'])"""),
    ("ipv4", rf"(?<![\d.]){_octet}(?:\.{_octet}){{3}}(?![\d]|\.\d)"),
    ("ipv6", rf"(?<![\w:.])(?:(?:{_hextet}:){{7}}{_hextet}|(?=\S*\d)(?:{_hextet}:){{1,6}}(?::{_hextet}){{1,6}})(?![\w:.])"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])(?:1-)?\d{3}-\d{3}-\d{4}(?![\w-])|(?<![\w.-])(?:1\.)?\d{3}\.\d{3}\.\d{4}(?!\w|\.\d)"),
    ("card", r"(?<![\w.-])\d{4}(?:[ -]\d{4}){3}(?![\w-])|(?<![\w.])\d{13,19}(?!\w)"),
    ("person", rf"\b(?:(?:{_title})\.? (?:(?:{_name}) )?{_surname}|(?:{_name}) {_surname})"),
)
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
#: What a text must hold for any pattern to match: most texts are passed over by these plain searches.
MAYBE = re.compile(r"[0-9@]|[=:]\s*[\"']|AKIA|xox|sk-|gh[pousr]_")
PAIR = re.compile(r"(?<!\w)([^\W\d_a-z][^\W\d_]+)\.? (?=[^\W\d_a-z])")
CALLED = {*TITLES, *NAMES}
SECRET = re.compile(_secret)


@dataclass
class Surrogates:
    """The keyed maps. One key, one mapping; another key, an unrelated one."""

    key: bytes
    cache: dict[tuple[str, str], str] = field(default_factory=dict)

    def _round(self, label: str, i: int, value: int, bound: int) -> int:
        width = (bound.bit_length() + 64) // 8 + 1
        out, given = b"", value.to_bytes(value.bit_length() // 8 + 1, "big")
        while len(out) < width:
            out += hmac.digest(self.key, f"{label}|{i}|{len(out)}|".encode() + given, "sha256")
        return int.from_bytes(out[:width], "big") % bound

    def _feistel(self, label: str, size: int, x: int, backwards: bool) -> int:
        """A permutation of range(size): alternating rounds over two factors of a near square, walked back into range."""
        a = 1 << ((size - 1).bit_length() + 1) // 2
        b = -(-size // a)
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(8)) if backwards else range(8):
                sign = -1 if backwards else 1
                if i % 2:
                    right = (right + sign * self._round(label, i, left, b)) % b
                else:
                    left = (left + sign * self._round(label, i, right, a)) % a
            x = left * b + right
            if x < size:
                return x

    def moved(self, label: str, size: int, x: int) -> int:
        """A bijection of range(size) that moves every value (a range of one has nowhere to go)."""
        return x if size < 2 else self._feistel(label, size, (self._feistel(label, size, x, False) + 1) % size, True)

    def by_alphabets(self, label: str, chars: str, alphabets: list[str | None]) -> str:
        """Characters replaced within their alphabets; those without one stay and are part of the format."""
        shape = "".join(c if a is None else f"<{a}>" for c, a in zip(chars, alphabets, strict=True))
        label = f"{label}|{sha256(shape.encode()).hexdigest()}"
        places = [i for i, a in enumerate(alphabets) if a is not None]
        out, before = list(chars), b""
        for at in range(0, len(places), BLOCK):
            block = places[at : at + BLOCK]
            size, x = 1, 0
            for i in block:
                size, x = size * len(alphabets[i]), x * len(alphabets[i]) + alphabets[i].index(chars[i])
            y = self.moved(f"{label}|{before.hex()}", size, x)
            before = sha256(before + "".join(chars[i] for i in block).encode()).digest()
            for i in reversed(block):
                y, k = divmod(y, len(alphabets[i]))
                out[i] = alphabets[i][k]
        return "".join(out)

    def within(self, label: str, text: str, holds: Callable[[str], bool], alphabets: list[str | None]) -> str:
        """As ``by_alphabets``, walked on until ``holds``: a bijection of what holds."""
        out = text
        while True:
            out = self.by_alphabets(label, out, alphabets)
            if holds(out):
                return out

    def of(self, kind: str, text: str) -> str:
        if (found := self.cache.get((kind, text))) is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            found = self.cache[kind, text] = getattr(self, f"_{kind}")(text)
        return found

    def _letters(self, label: str, text: str, holds: Callable[[str], bool] = lambda _: True) -> str:
        """Letters and digits replaced whatever their case, which is put on again."""
        plain = "".join(c.lower() if c in CLASS_OF else c for c in text)
        new = self.within(label, plain, holds, [CLASS_OF.get(c) for c in plain])
        return "".join(b.upper() if a != c else b for a, b, c in zip(text, new, plain, strict=True))

    def _email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{self._letters('local', local)}@{self._letters('host', host)}.{top}"

    def _secret(self, text: str) -> str:
        if all(c in HEX for c in text):
            return self.by_alphabets("hex", text, [HEX] * len(text))
        start = re.match(r"AKIA|gh[pousr]_|sk-|xox[abpr]-", text)
        at = start.end() if start else 0
        return text[:at] + self.by_alphabets("secret", text[at:], wide(text[at:]))

    def _assigned(self, text: str) -> str:
        at = max(text.rfind('"'), text.rfind("'")) + 1
        value = text[at:]
        if (kind := value_kind(value)) == "key":
            return text[:at] + self._secret(value)
        alphabets = {"digits": [DIGITS] * len(value), "hex": [HEX] * len(value), "marks": [MARKS if c in MARKS else None for c in value]}.get(kind) or wide(value)
        return text[:at] + self.within(f"assigned {kind}", value, lambda x: value_kind(x) == kind, alphabets)

    def _ipv4(self, text: str) -> str:
        value = int(ipaddress.IPv4Address(text))
        for first, bits in ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24), (169 << 24 | 254 << 16, 16)):
            if value >> bits == first >> bits:
                return str(ipaddress.IPv4Address(first | self.moved(f"ip|{first}", 1 << bits, value - first)))
        kind = address_kind(value)
        out = value
        while True:
            out = self.moved("ip", 1 << 32, out)
            if address_kind(out) == kind:
                return str(ipaddress.IPv4Address(out))

    def _ipv6(self, text: str) -> str:
        """The first group, which tells what an address is for, stays."""
        at = text.index(":")
        low = text.lower()
        new = low[:at] + self.by_alphabets(f"ipv6|{low[:at]}", low[at:], [HEX if c in HEX else None for c in low[at:]])
        return new.upper() if text.isupper() else new

    def _iban(self, text: str) -> str:
        """Valid numbers stay valid; an invalid one keeps its two digits and stays invalid."""
        plain = text.replace(" ", "")
        country, check, body = plain[:2], plain[2:4], plain[4:]
        if iban_digits(country, body) == check:
            body = self.by_alphabets(f"iban|{country}", body, wide(body))
            check = iban_digits(country, body)
        else:
            body = self.within(f"iban|{country}|{check}", body, lambda x: iban_digits(country, x) != check, wide(body))
        rest = iter(country + check + body)
        return "".join(c if c == " " else next(rest) for c in text)

    def _ssn(self, text: str) -> str:
        return self.by_alphabets("ssn", text, [DIGITS if c.isdigit() else None for c in text])

    def _phone(self, text: str) -> str:
        """Country code and national digits are permuted alike however they are grouped; ten digits without a code are of +1."""
        at = [i for i, c in enumerate(text) if c in DIGITS]
        digits = "".join(text[i] for i in at)
        code = COUNTRY.match(digits)[0] if text[0] == "+" else ""
        trunk = text.find("(0)") if code != "1" else -1  # a trunk zero isn't part of the number
        prefix = len(code) if code or len(digits) != 11 else 1  # 1-800-...: the code without its plus
        at = [i for i in at[prefix:] if i != trunk + 1 or trunk < 0]
        body = "".join(text[i] for i in at)
        code = code or "1"
        # The first digit, and that of the exchange in +1, stays above 1 or below 2.
        firsts = {0, 3} if code == "1" and len(body) == 10 else {0}
        alphabets = [(DIGITS[:2] if c < "2" else DIGITS[2:]) if i in firsts else DIGITS for i, c in enumerate(body)]
        out = list(text)
        for i, c in zip(at, self.by_alphabets(f"phone|{code}", body, alphabets), strict=True):
            out[i] = c
        return "".join(out)

    def _card(self, text: str) -> str:
        digits = [i for i, c in enumerate(text) if c in DIGITS]
        plain = "".join(text[i] for i in digits)
        alphabets: list[str | None] = [None] + [DIGITS] * (len(plain) - 1)  # the issuer's group stays
        if luhn(plain[:-1]) == plain[-1]:
            body = self.by_alphabets("card", plain[:-1], alphabets[:-1])
            plain = body + luhn(body)
        else:
            plain = self.within("card", plain, lambda x: luhn(x[:-1]) != x[-1], alphabets)
        out = list(text)
        for i, c in zip(digits, plain, strict=True):
            out[i] = c
        return "".join(out)

    def _person(self, text: str) -> str:
        out: list[str] = []
        for w in text.split(" "):
            out.append(w if w.rstrip(".") in TITLES and not out else self._name(w))
        return " ".join(out)

    def _name(self, word: str) -> str:
        """A listed given name becomes another one wherever it stands, any other word one that isn't listed."""
        if (given := EXACT.get(word.lower())) is None:
            return self._letters("surname", word, lambda x: x not in EXACT)
        names, gender = NAMES[given]
        new = names[self.moved(f"given|{names[0]}|{gender}", len(names), names.index(given))]
        return new.upper() if word.isupper() else new

    def replace(self, text: str) -> tuple[str, list[dict]]:
        """The text with surrogates, and the entities: type, start (code points of the original), original, surrogate."""
        if not MAYBE.search(text) and CALLED.isdisjoint(PAIR.findall(text)):
            return text, []
        hits = [(m.start(), m[0], m.lastgroup or "") for m in FINDER.finditer(text)]
        hits = sorted(hits + mentions(text, hits))
        found: list[dict] = []
        out: list[str] = []
        at = 0
        for start, original, kind in hits:
            new = self.of(kind, original)
            found.append({"type": kind, "start": start, "original": original, "surrogate": new})
            out += (text[at:start], new)
            at = start + len(original)
        return ("".join(out) + text[at:] if found else text), found


def mentions(text: str, hits: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """Words of the persons among ``hits`` where they stand alone between the hits."""
    names = {w for _, x, kind in hits if kind == "person" for w in x.split(" ") if w.rstrip(".") not in TITLES}
    if not names:
        return []
    bounds = [0, *(b for start, x, _ in hits for b in (start, start + len(x))), len(text)]
    gaps = [(a, b) for a, b in zip(bounds[::2], bounds[1::2], strict=True) if any(text.find(n, a, b) >= 0 for n in names)]
    if not gaps:
        return []
    word = re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})\b")
    return [(m.start(), m[0], "person") for a, b in gaps for m in word.finditer(text, a, b)]


def wide(text: str) -> list[str | None]:
    """Capitals, small letters and digits among themselves; letters of other scripts within their alphabets."""
    sets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", DIGITS)
    return [next((a for a in sets if c in a), CLASS_OF.get(c)) for c in text]


def value_kind(value: str) -> str:
    """What an assigned value looks like. Surrogates stay in their kind."""
    if SECRET.fullmatch(value):
        return "key"
    if all(c in DIGITS for c in value):
        return "digits"
    if all(c in HEX for c in value):
        return "hex"
    return "other" if any(a for a in wide(value)) else "marks"


def address_kind(value: int) -> str:
    """Private and other special blocks, multicast and above, or public."""
    top = value >> 24
    special = top in (0, 10, 127) or value >> 20 == 172 << 4 | 1 or value >> 16 in (192 << 8 | 168, 169 << 8 | 254)
    return f"special {top}" if special else "multicast" if top >= 224 else "public"


def luhn(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def iban_digits(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


@lru_cache(maxsize=8)
def keyed(key: str) -> Surrogates:
    return Surrogates(key.encode())


ENTITY = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("original", pa.string()), ("surrogate", pa.string())]))
ENTITY_DDL = "array<struct<type:string,start:int,original:string,surrogate:string>>"


def replaced(docs: DataFrame, key: str, entities: str) -> DataFrame:
    """``docs`` with its texts replaced and, as ``entities``, what was found in them. One pass, no shuffle."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = keyed(key)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                columns = list(b.columns)
                done = [(None, []) if t is None else maps.replace(t) for t in columns[where].to_pylist()]
                columns[where] = pa.array([t for t, _ in done], columns[where].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([e for _, e in done], ENTITY)], names=[*b.schema.names, entities])

    schema = StructType([*docs.schema.fields, StructField(entities, docs.sparkSession.createDataFrame([], f"e {ENTITY_DDL}").schema["e"].dataType)])
    return docs.mapInArrow(run, schema)


class Collision(ValueError):
    pass


def checked(rows: DataFrame, entities: str) -> DataFrame:
    """``rows`` written down, if over all of them different entities have different surrogates and equal ones equal ones.

    By construction they do; a result in which they don't is not handed out.
    """
    rows = pinned(rows, "surrogates")
    if faults := collisions(rows, entities).limit(5).collect():
        raise Collision(f"surrogates that don't stand for one entity each: {[(r.type, r.fault) for r in faults]}")
    return rows


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, entities``: texts with surrogates, and what was found; checked for collisions."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return checked(replaced(picked, key, "entities"), "entities")


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its texts replaced, all other columns as they are; checked for collisions."""
    (entities,) = spare(docs, "entities")
    return checked(replaced(docs, key, entities), entities).drop(entities)


def collisions(rows: DataFrame, entities: str = "entities") -> DataFrame:
    """Surrogates that stand for more than one original, and originals with more than one surrogate: none is expected."""
    pairs = rows.select(F.explode(entities).alias("e")).select("e.type", "e.original", "e.surrogate").distinct()
    merged = pairs.groupBy("type", "surrogate").agg(F.count("*").alias("n")).where("n > 1").select("type", F.col("surrogate").alias("value"), F.lit("merged").alias("fault"))
    split = pairs.groupBy("type", "original").agg(F.count("*").alias("n")).where("n > 1").select("type", F.col("original").alias("value"), F.lit("split").alias("fault"))
    return merged.unionByName(split)
