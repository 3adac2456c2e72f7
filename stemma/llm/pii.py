"""Personal data replaced by keyed surrogates of the same type.

Entities are mail addresses, phone, card and account numbers, IP addresses and
names behind a title.  Each has a canonical form (a number's digits, a lower-case
address, a name's word), so that all its mentions, however written, get one
surrogate, which is then written as each mention was: separators, lengths, letter
case and script stay, a card number keeps its check digit valid, an address its
domain's shape, and a name the gender that its title tells.

A word that is a name is one entity wherever it stands: whichever titles it has
in the table decide its gender, and conflicting ones leave it open.

A surrogate is drawn by a keyed hash of the canonical form and an attempt.  All
distinct entities of the table are then checked against each other by what a
reader sees, whatever their kinds: one whose surrogate another entity has too, or
which reads like an entity, draws again with the next attempt, until all differ.
So distinct entities stay distinct, over all documents.

Edge cases: null and empty texts stay as they are; a text without entities is
returned unchanged; repeated rows are treated alike; an empty table gives no
rows; very long texts take time in proportion and must fit into a task's memory;
a format with too few forms for its entities is widened: private addresses first
to 10.0.0.0/8 and then to public ones, digits by a digit, so that none is left over.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import Scratch, block_join, cut, ready, slices

# Titles and the gender that each tells (f, m, or x for neither).
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Señor": "m", "Sr": "m", "Don": "m",
    "Monsieur": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Señora": "f", "Señorita": "f", "Sra": "f",
    "Doña": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "x", "Prof": "x",
}
_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w.+-])[3-6]\d{3}(?:[ -]?\d){9,15}(?!\w|[.-]\d)"),
    "ssn": re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?!\w|[.-]\d)"),
    "ip": re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"),
    "phone": re.compile(r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{4}(?!\w|[.-]\d)|(?<![\w+])\+\d{8,15}(?!\w)"),
}
# A local part from its run's first character on, so that no run is tried twice; and a domain.
_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
KINDS = ("email", *PATTERNS, "name")
_TITLED = re.compile(rf"(?<!\w)({'|'.join(TITLES)})\.? ({_NAME})(?: ({_NAME}))?")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+")
# Syllable starts and vowels of made-up names, by script.
SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", "a", "n"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а", "н"),
    "greek": ("βγδζκλμνπρστφ", "αειου", "α", "ς"),
}
MAX_ATTEMPTS = 60
#: Attempts after which a format counts as full and is widened, and widened again.
WIDEN = (8, 20)

#: An entity's mention: where it begins and ends, its kind, its canonical form, and the gender that its title tells.
Mention = tuple[int, int, str, str, str]


def _canonical(kind: str, found: str) -> str:
    if kind == "email":
        return found.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in found.split("."))
    if kind == "iban":
        return found.replace(" ", "")
    return "".join(_DIGIT.findall(found))


def _addresses(text: str) -> list[Mention]:
    found = []
    for m in _LOCAL.finditer(text):
        local = m[0][:-1].lstrip("._%+-")
        domain = _DOMAIN.match(text, m.end(), m.end() + 253)
        if local and local[-1] != "." and domain:
            start = m.end() - 1 - len(local)
            found.append((start, domain.end(), "email", _canonical("email", text[start : domain.end()]), "x"))
    return found


def mentions(text: str | None) -> list[Mention]:
    """The entities of a text, left to right, without overlaps; kinds listed first win."""
    if not text:
        return []
    found = _addresses(text) if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in PATTERNS.items():
            found += [(m.start(), m.end(), kind, _canonical(kind, m[0]), "x") for m in pattern.finditer(text)]
    names: dict[str, set[str]] = {}
    for m in _TITLED.finditer(text):
        words = [w for w in (m[2], m[3]) if w]
        for i, w in enumerate(words):
            names.setdefault(w, set()).add("x" if i == len(words) - 1 else TITLES[m[1]])
    if names:  # their later mentions too, with or without a title
        told = {w: (g - {"x"}).pop() if len(g - {"x"}) == 1 else "x" for w, g in names.items()}
        for m in _WORD.finditer(text):
            if m[0] in told and len(m[0]) > 2:
                found.append((m.start(), m.end(), "name", m[0].lower(), told[m[0]]))
    starts, taken = [], []
    for x in sorted(found, key=lambda x: (KINDS.index(x[2]), x[0])):
        at = bisect(starts, x[0])
        if (at == 0 or taken[at - 1][1] <= x[0]) and (at == len(taken) or x[1] <= taken[at][0]):
            starts.insert(at, x[0])
            taken.insert(at, x)
    return taken


def entity(kind: str, canonical: str) -> str:
    return f"{kind}:{canonical}"


class _Stream:
    """Numbers from a keyed hash, as many as asked for."""

    def __init__(self, key: bytes, seed: str):
        self.key, self.seed, self.block, self.left = key, seed.encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, self.seed + b"|%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x * n >> 32

    def like(self, c: str) -> str:
        if c.isdigit():
            return str(self.below(10))
        if "a" <= c <= "z":
            return chr(97 + self.below(26))
        if "A" <= c <= "Z":
            return chr(65 + self.below(26))
        return c


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


def _script(word: str) -> str | None:
    """The script of a name whose syllables are known; None for others."""
    ranges = {"latin": ("A", "ɏ"), "cyrillic": ("Ѐ", "ӿ"), "greek": ("Ͱ", "Ͽ")}
    return next((name for name, (a, z) in ranges.items() if a <= word[0] <= z), None)


def _kind(c: str) -> tuple[str, str]:
    """A character's category, and the script that its name begins with."""
    return unicodedata.category(c), unicodedata.name(c, "").partition(" ")[0]


@functools.cache
def _alike(block: int, kind: tuple[str, str]) -> str:
    """The letters of one category and script in a run of 128 code points."""
    return "".join(c for c in map(chr, range(block << 7, block + 1 << 7)) if _kind(c) == kind)


def _check_digits(iban: str) -> str:
    """An account number's two check digits: the whole, its head moved to the end, is 1 modulo 97."""
    value = "".join(str(int(c, 36)) for c in iban[4:] + iban[:2] + "00")
    return f"{98 - int(value) % 97:02d}"


def _address(octets: list[int], s: _Stream, attempt: int = 0) -> str:
    """Private and loopback addresses stay in their range while it has room; others get one outside of the reserved ranges."""
    a, b = octets[:2]
    private = a in (10, 127) or (a, b) == (192, 168) or a == 172 and 16 <= b < 32
    if private and attempt >= WIDEN[0] and attempt < WIDEN[1]:
        head = [10]
    elif a in (10, 127) and attempt < WIDEN[0]:
        head = [a]
    elif (a, b) == (192, 168) and attempt < WIDEN[0]:
        head = [a, b]
    elif private and attempt < WIDEN[0]:
        head = [a, 16 + s.below(16)]
    else:
        head = [s.below(222) + 1]
        while head[0] in (10, 100, 127, 169, 172, 192, 198, 203):
            head = [s.below(222) + 1]
    return ".".join(map(str, [*head, *(1 + s.below(254) for _ in range(4 - len(head)))]))


def surrogate(key: bytes, kind: str, canonical: str, attempt: int, gender: str = "x") -> str:
    """A canonical form of the same kind and format."""
    s = _Stream(key, f"{kind}|{canonical}|{attempt}")
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        d = _Stream(key, f"domain|{domain}|{attempt}")  # one for all addresses of a domain
        hidden = ["".join(d.like(c) for c in x) for x in labels[:-1]]
        return "".join(s.like(c) for c in local) + "@" + ".".join([*hidden, labels[-1]])
    if kind == "ip":
        return _address([int(x) for x in canonical.split(".")], s, attempt)
    if kind == "iban":
        out = canonical[:4] + "".join(s.like(c) for c in canonical[4:])
        return out[:2] + _check_digits(out) + out[4:]
    if kind in ("card", "ssn", "phone"):
        keep = 1 if kind == "card" else 0
        more = sum(attempt >= w for w in WIDEN)
        out = canonical[:keep] + "".join(str(s.below(9) + 1) if i == 0 and not keep else str(s.below(10)) for i in range(len(canonical) - keep + more))
        if kind == "card" and luhn(canonical):
            out = next(out[:-1] + c for c in "0123456789" if luhn(out[:-1] + c))
        return out
    if (script := _script(canonical)) is None:  # letter by letter, each by one of its block
        more = canonical[-1] * (attempt // 4)
        return "".join(alike[s.below(len(alike))] if c.isalpha() and (alike := _alike(ord(c) >> 7, _kind(c))) else c for c in canonical + more)
    starts, vowels, female, male = SYLLABLES[script]
    n = max(2, min(4, len(canonical) // 2)) + attempt // 4
    word = "".join(starts[s.below(len(starts))] + vowels[s.below(len(vowels))] for _ in range(n))
    return word + {"f": starts[0] + female, "m": male, "x": ""}[gender]


def written_like(found: str, kind: str, made: str) -> str:
    """The canonical surrogate ``made`` in the form of the mention ``found``."""
    if kind == "email":
        return "".join(c.upper() if i < len(found) and found[i].isupper() else c for i, c in enumerate(made))
    if kind == "ip":
        return made
    if kind in PATTERNS:
        left = iter(made)
        return "".join(next(left) if c.isalnum() else c for c in found) + "".join(left)
    return made.upper() if found.isupper() else made.capitalize() if found[0].isupper() else made


def replaced(text: str, made: dict[str, str]) -> tuple[str, int]:
    """``text`` with every mention replaced, and how many there were."""
    out, at, n = [], 0, 0
    for start, end, kind, canonical, _ in mentions(text):
        out += [text[at:start], written_like(text[start:end], kind, made[entity(kind, canonical)])]
        at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct entities of all texts, with the gender of names: (entity, gender)."""

    def run(batches):
        for b in batches:
            for part in slices([b], text):
                found = sorted({(entity(k, c), g) for t in part[text] for _, _, k, c, g in mentions(t)})
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["entity", "gender"])

    f, m = (F.bool_or(F.col("gender") == g) for g in "fm")
    told = docs.select(text).mapInArrow(run, "entity string, gender string").groupBy("entity").agg(f.alias("f"), m.alias("m"))
    return told.select("entity", F.when(F.col("f") == F.col("m"), "x").when(F.col("f"), "f").otherwise("m").alias("gender"))


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(key, surrogate) for every entity (entity, gender): distinct, and none of them an entity itself.

    Each round checks all surrogates as they are read, without their kinds; of the
    entities that drew one surrogate the first by a hash keeps it.  The rounds end
    when none has to draw again.
    """

    def draw(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("entity", "attempt", "gender")), strict=True)
            made = [surrogate(key, *e.split(":", 1), attempt, gender) for e, attempt, gender in rows]
            yield b.append_column("made", pa.array(made, pa.string()))

    scratch, kinds = Scratch(found.sparkSession), "entity string, gender string, attempt int, again boolean"
    now = scratch.cut(found.select("entity", "gender", F.lit(0).alias("attempt"), F.lit(True).alias("again")))
    real = now.select(F.expr("substring(entity, instr(entity, ':') + 1)").alias("made"), F.lit(True).alias("real")).distinct()
    for _ in range(MAX_ATTEMPTS):
        drawn = scratch.cut(now.mapInArrow(draw, f"{kinds}, made string"))
        # One that has its surrogate keeps it, so that each draws as often as it must and no more.
        order = Window.partitionBy("made").orderBy("again", F.xxhash64("entity"), "entity")
        checked = drawn.join(real, "made", "left").withColumn("place", F.row_number().over(order))
        again = F.col("real").isNotNull() | (F.col("place") > 1)
        now = scratch.cut(checked.select("entity", "gender", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")))
        if now.filter("again").isEmpty():
            done = cut(drawn.select(F.col("entity").alias("key"), F.col("made").alias("surrogate")))
            scratch.clear()
            return done
    raise RuntimeError("no distinct surrogates: a format has fewer forms than entities")


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text") -> DataFrame:
    """``docs`` with its text's entities replaced, and ``n_entities``; a column of that name is replaced."""
    ready(docs.sparkSession)
    kept = docs.drop("n_entities")
    out = StructType([*kept.schema, StructField("n_entities", LongType())])

    def wanted(texts: Iterable[list[str | None]]) -> list[str]:
        return sorted({entity(k, c) for part in texts for t in part for _, _, k, c, _ in mentions(t)})

    def answered(found: pa.Table):
        made = dict(zip(found.column("key").to_pylist(), found.column("surrogate").to_pylist(), strict=True))

        def apply(part: pa.Table) -> pa.Table:
            pairs = [replaced(t, made) if t else (t, 0) for t in part.column(text).to_pylist()]
            at = part.schema.get_field_index(text)
            part = part.set_column(at, text, pa.array([t for t, _ in pairs], pa.string()))
            return part.append_column("n_entities", pa.array([n for _, n in pairs], pa.int64()))

        return apply

    return block_join(kept, assign(entities(docs, text), key), text, wanted, pa.string(), answered, out)
