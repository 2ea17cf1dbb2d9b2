"""PII: keyed surrogates in place of detected entities.

E-mail addresses, phone, card and social security numbers, IBANs, IPv4 addresses, secrets
(keys, tokens, passwords) and names of persons get replacements of the same type, format and
script; given names keep their gender. A surrogate is a keyed permutation of its entity
(Feistel rounds over the entity's own alphabet and length), so equal entities get equal
surrogates everywhere and different ones of a format different ones. Valid card numbers and
IBANs stay valid and invalid ones invalid; an address keeps the type of its domain.

Persons are found by given names, forms of address and introductions ("my name is"), in any
script; a name found in one of these ways is replaced wherever it stands alone in the text.
Detection looks at the surroundings of digits, at signs and capitals only, once for each text:
its spans are stored beside the rows.

Collision checks run over the distinct entities of the table: an entity whose surrogate is
another's too, or occurs itself as an entity, gets the next permutation, until none is left;
from attempt LONGER_FROM on it gets a longer form of the same script, since its own length may
be full. A fixed format (digits, addresses) may have no unused form left; what is still not
settled after a number of rounds gets a mark with its type and a keyed number instead (FULL).
Given names need no check: within their list they are shifted, so they stay distinct.
Exceptions, if any, reach the rows that have entities by a join.

Defined results: null text stays null with no entity; empty text stays empty; repeated rows
get equal results; an empty table gives no rows; columns other than doc_id and text are
ignored by the query and kept by `with_surrogates`, but for one that has the result's name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored

ROUNDS = 8
#: The attempt from which names, e-mail addresses and secrets get longer, by a letter every second one.
LONGER_FROM = 6
#: The attempt that stands for a mark, since the entity's domain has no unused form.
FULL = -1
#: Alphabets whose members may stand for each other.
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
HEX = "0123456789abcdef"
MARKS = "_+-/"
#: Given names by script and gender.
GIVEN = {
    "latin m": ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Matthew", "Andrew", "Hans", "Klaus", "Jürgen", "Pierre", "Jacques", "François", "Carlos", "Miguel", "José", "Javier"],
    "latin f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Karen", "Emily", "Ursula", "Monika", "Sabine", "Marie", "Nathalie", "Françoise", "Carmen", "Lucía", "Isabel", "Pilar"],
    "cyrillic m": ["Иван", "Сергей", "Дмитрий", "Андрей", "Алексей", "Михаил"],
    "cyrillic f": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна"],
    "greek m": ["Γιώργος", "Νίκος", "Κώστας", "Δημήτρης"],
    "greek f": ["Ελένη", "Κατερίνα", "Σοφία", "Ιωάννα"],
}
#: Forms of address before a surname.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Herr", "Frau", "Mme", "Madame", "Monsieur", "Señor", "Señora", "Sra"]
#: Labels that stand for a kind of domain before a country's.
SECOND_LEVEL = {"co", "com", "org", "net", "ac", "edu", "gov", "gob", "gouv", "or", "ne", "go"}
PLACE = {name: (group, i) for group, names in GIVEN.items() for i, name in enumerate(names)}
CLASS = {c: (k, i) for k, a in enumerate(ALPHABETS) for i, c in enumerate(a)}

SECRET_AFTER = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s*[=:]\s*[\"']?"
PATTERNS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")),
    ("secret", re.compile(rf"{SECRET_AFTER}([A-Za-z0-9_+/-]{{6,}})")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    ("card", re.compile(r"(?<![\d.])\d{13,19}(?!\d)")),
    ("card", re.compile(r"(?<![\d.])\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}(?!\d)")),
    ("card", re.compile(r"(?<![\d.])\d{4}[ -]\d{6}[ -]\d{5}(?!\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)")),
    ("phone", re.compile(r"(?<![\w.])\+\d{8,14}(?!\d)")),
]
REST = r"[\w-]*(?:['’](?![sS]\b)[\w-]+)*"
NAME = r"[^\W\d_]" + REST
#: Phrases after which a person is named.
INTRODUCTIONS = ["my name is", "name:", "contact person:", "ich heiße", "mein name ist", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут", "με λένε"]
INTRODUCED = re.compile(rf"(?i:(?<!\w)(?:{'|'.join(INTRODUCTIONS)}))[ \t]+({NAME}(?: {NAME}){{0,2}})")
PERSON = re.compile(rf"(?<![\w'’-])({NAME})(\.? )(?=({NAME}))")
CAPITAL = re.compile(r"[A-ZÀ-ÞΆ-ΫЀ-Я]\w*")
WORD, DIGITS, SPACE = re.compile(NAME), re.compile(r"\d+"), re.compile(r"\s")
#: Words that announce a secret, and beginnings of keys.
ANNOUNCED, KEYS = ("passw", "pwd", "token", "secret", "key"), ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
#: Characters around digits that any entity with digits lies within, and the least digits of one.
AROUND, LEAST_DIGITS = 48, 4
TYPES = ["email", "secret", "iban", "ip", "card", "ssn", "phone", "given", "surname"]
CALLED = set(PLACE) | set(TITLES)


def widened(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in ascending order, each widened to the white space around it; those that then meet are one."""
    out, seen = [], 0
    for start, end in places:
        if end > seen:
            space = SPACE.search(text, end)
            end = space.start() if space else len(text)
        while start > seen and not text[start - 1].isspace():
            start -= 1
        if out and start <= seen:
            start = out.pop()[0]
        seen = max(end, seen)
        out.append((start, seen))
    return out


def numeric_places(text: str) -> list[tuple[int, int]]:
    """Surroundings of LEAST_DIGITS digits or more that lie within AROUND of each other."""
    out, first, last, n = [], 0, -1, 0
    for m in DIGITS.finditer(text):
        if last >= 0 and m.start() - last > AROUND:
            if n >= LEAST_DIGITS:
                out.append((max(0, first - AROUND), min(len(text), last + AROUND)))
            n = 0
        if not n:
            first = m.start()
        last, n = m.end(), n + m.end() - m.start()
    if n >= LEAST_DIGITS:
        out.append((max(0, first - AROUND), min(len(text), last + AROUND)))
    return out


def sign_places(text: str, signs: tuple[str, ...], after: int = 0) -> list[tuple[int, int]]:
    out = []
    for sign in signs:
        at = text.find(sign)
        while at >= 0:
            out.append((at, min(len(text), at + len(sign) + after)))
            at = text.find(sign, at + 1)
    return sorted(out)


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities, in order and without overlap; an earlier type of PATTERNS goes first, persons last."""
    starts, found = [], []
    numeric, low = numeric_places(text), text.lower()
    if len(low) != len(text):  # places in the lower-cased text would be others
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    places = {"email": widened(text, sign_places(text, ("@",)))}
    places["secret"] = widened(text, sorted(numeric + sign_places(low, ANNOUNCED, AROUND) + sign_places(text, KEYS)))
    numeric = widened(text, numeric)

    def add(start: int, end: int, kind: str, norm: str) -> None:
        i = bisect_left(starts, start)
        if (i == 0 or found[i - 1][1] <= start) and (i == len(starts) or end <= starts[i]):
            starts.insert(i, start)
            found.insert(i, (start, end, kind, norm))

    for kind, pattern in PATTERNS:
        for s, e in places.get(kind, numeric):
            for m in pattern.finditer(text, s, e):
                start, end = m.span(1 if kind == "secret" else 0)
                x = text[start:end]
                norm = x.lower() if kind == "email" else x if kind in ("secret", "ip") else re.sub(r"[ -]", "", x) if kind == "iban" else re.sub(r"[^\d+]", "", x)
                add(start, end, kind, norm)
    named = {}
    for start, end, kind, norm in persons(text, low):
        add(start, end, kind, norm)
        named |= {form: (kind, norm) for form in (text[start:end], text[start:end].upper(), text[start:end].title())}
    if named:  # the same names where they stand alone
        for m in WORD.finditer(text):
            if m[0] in named:
                add(*m.span(), *named[m[0]])
    return found


def _a_name(word: str) -> bool:
    """Begins with a capital, or with a letter of a script that has none."""
    return not word[0].islower() and word[0].isalpha()


def persons(text: str, low: str) -> list[tuple[int, int, str, str]]:
    """Given names with the surname after them, surnames after a form of address, names after an introduction."""
    out = []
    if not CALLED.isdisjoint(CAPITAL.findall(text)):
        for m in PERSON.finditer(text):
            if m[1] in PLACE and m[2] == " " and _a_name(m[3]):
                out += [(*m.span(1), "given", m[1]), (*m.span(3), "surname", m[3].lower())]
            elif m[1] in TITLES and _a_name(m[3]) and m[3] not in PLACE:
                out.append((*m.span(3), "surname", m[3].lower()))
    if any(x in low for x in INTRODUCTIONS):
        for m in INTRODUCED.finditer(text):
            for w in WORD.finditer(text, *m.span(1)):
                if not _a_name(w[0]):
                    break
                out.append((*w.span(), "given", w[0]) if w[0] in PLACE else (*w.span(), "surname", w[0].lower()))
    return out


def permuted(values: list[int], radix: int, key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the lists of this length over 0..radix-1."""
    n = len(values)

    def f(data: str, bound: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{n}|{radix}|{data}".encode(), key=key, digest_size=32).digest(), "big") % bound

    if n == 1:
        return [(values[0] + 1 + f("one", radix - 1)) % radix]
    u = n // 2
    a = b = 0
    for v in values[:u]:
        a = a * radix + v
    for v in values[u:]:
        b = b * radix + v
    size_a, size_b = radix**u, radix ** (n - u)
    for i in range(ROUNDS):
        if i % 2:
            b = (b + f(f"{i}|{a}", size_b)) % size_b
        else:
            a = (a + f(f"{i}|{b}", size_a)) % size_a
    out = []
    for x, m in ((a, u), (b, n - u)):
        part = []
        for _ in range(m):
            x, r = divmod(x, radix)
            part.append(r)
        out += part[::-1]
    return out


@lru_cache(1000)
def other_letters(block: int) -> str:
    """The letters outside ALPHABETS of 128 code points, as far as case can be kept: an alphabet of their own."""
    chars = [c for c in map(chr, range(block * 128, block * 128 + 128)) if c.isalpha()]
    cased = any(c.islower() and c.upper() != c for c in chars)  # then signs without case are no letters of names
    return "".join(c for c in chars if c not in CLASS and c.lower() == c and len(c.upper()) == 1 and c.upper().lower() == c and (c.upper() != c or not cased))


def class_of(c: str) -> tuple[str, str, int] | None:
    """Name and letters of the character's alphabet, and its place there."""
    low = c.lower()
    if (k := CLASS.get(low)) is not None:
        return str(k[0]), ALPHABETS[k[0]], k[1]
    if len(low) == 1 and low.isalpha() and low in (letters := other_letters(ord(low) // 128)) and len(letters) > 1:
        return f"block {ord(low) // 128}", letters, letters.index(low)
    return None


def preserved(s: str, key: bytes, tweak: str) -> str:
    """s with the letters and digits of each alphabet permuted, marks if there is nothing else; case and all else as they are."""
    out, places = list(s), {}
    for i, c in enumerate(s):
        if (k := class_of(c)) is not None:
            places.setdefault(k[:2], []).append((i, k[2]))
    if not places:
        marks = MARKS if "/" in s else MARKS[:-1]
        places = {("marks", marks): [(i, marks.index(c)) for i, c in enumerate(s) if c in marks]}
    for (k, letters), at in places.items():
        for (i, _), v in zip(at, permuted([v for _, v in at], len(letters), key, f"{tweak}|{k}") if at else [], strict=True):
            c = letters[v]
            out[i] = c.upper() if s[i].isupper() else c
    return "".join(out)


def _digits(s: str, key: bytes, tweak: str) -> str:
    return "".join(map(str, permuted([int(c) for c in s], 10, key, tweak)))


def luhn(s: str) -> bool:
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def iban_rest(s: str) -> int:
    """Remainder by 97 of an IBAN as a number: 1 if it is valid."""
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(s: str, key: bytes, tweak: str) -> str:
    """Same country, all else permuted; valid for valid ones, by new check digits, and invalid for others."""
    if iban_rest(s) == 1:
        body = preserved(s[4:], key, f"{tweak}|{s[:2]}|valid")
        return f"{s[:2]}{98 - iban_rest(s[:2] + '00' + body):02}{body}"
    out = s
    while out == s or iban_rest(out) == 1:  # walks the permutation's cycle back into the invalid numbers
        out = out[:2] + preserved(out[2:], key, f"{tweak}|{s[:2]}")
    return out


def lengthened(s: str, attempt: int) -> str:
    """s, from attempt LONGER_FROM on with its last letter, digit or mark repeated."""
    if attempt < LONGER_FROM:
        return s
    last = next((c for c in reversed(s) if class_of(c)), next((c for c in reversed(s) if c in MARKS), "x"))
    return s + last * ((attempt - LONGER_FROM) // 2 + 1)


@lru_cache(100_000)
def surrogate(kind: str, norm: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate's normal form."""
    if attempt == FULL:
        return f"[{kind} {hashlib.blake2b(f'{kind}|{norm}'.encode(), key=key, digest_size=12).hexdigest()}]"
    t = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        labels = domain.split(".")
        # what tells the domain's type stays: its last label, and the one before where that is no name
        keep = 2 if len(labels) > 2 and (labels[-2] in SECOND_LEVEL or labels[-2] == "example") else 1
        return f"{preserved(lengthened(local, attempt), key, f'{t}|{domain}')}@{'.'.join([*(preserved(x, key, f'{t}|{domain}') for x in labels[:-keep]), *labels[-keep:]])}"
    if kind == "ip":
        v = permuted([int(x) for x in norm.split(".")], 256, key, t)
        return ".".join(map(str, v))
    if kind == "card":
        if luhn(norm):
            body = _digits(norm[:-1], key, t + "|valid")
            return next(body + c for c in "0123456789" if luhn(body + c))
        s = _digits(norm, key, t)
        while luhn(s):  # walks the permutation's cycle back into the invalid numbers
            s = _digits(s, key, t)
        return s
    if kind == "phone":
        m = re.match(r"\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})?", norm)
        head = m[0] if m else ""
        return head + _digits(norm[len(head) :], key, f"{t}|{head}")
    if kind == "ssn":
        return _digits(norm, key, t)
    if kind == "iban":
        return _iban(norm, key, t)
    if kind == "given":
        group, i = PLACE[norm]
        names = GIVEN[group]
        return names[(i + 1 + int.from_bytes(hashlib.blake2b(f"{group}|{attempt}".encode(), key=key, digest_size=8).digest(), "big") % (len(names) - 1)) % len(names)]
    if kind == "secret":
        head = next((h for h in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-") if norm.startswith(h)), "")
        body = lengthened(norm[len(head) :], attempt)
        if body == body.lower() and all(c in HEX for c in body) or body == body.upper() and all(c in HEX.upper() for c in body):
            out = "".join(HEX[v] for v in permuted([HEX.index(c) for c in body.lower()], 16, key, t))
            # hex digits without a letter say nothing of case; they are written as they come
            return head + (out.upper() if body != body.lower() else out)
        return head + preserved(body, key, f"{t}|{head}")
    return preserved(lengthened(norm, attempt), key, t)


def written(mention: str, kind: str, new: str) -> str:
    """The surrogate in the mention's own format; a mark as it is."""
    if new.startswith(f"[{kind} "):
        return new
    if kind in ("card", "phone", "ssn"):
        digits = iter(re.sub(r"\D", "", new))
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        chars = iter(new)
        return "".join(c if c in " -" else next(chars) for c in mention)
    if kind == "email":
        if mention == mention.upper():
            return new.upper()
        return "".join(c.upper() if i < len(mention) and i < mention.find("@") and mention[i].isupper() else c for i, c in enumerate(new))
    if kind == "surname":
        return "".join(c.upper() if mention[min(i, len(mention) - 1)].isupper() else c for i, c in enumerate(new))
    return new


def applied(text: str, spans: list[tuple[int, int, str, str]], key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, list[str]]:
    """The text with surrogates at the spans, and their types."""
    out, at = [], 0
    for start, end, kind, norm in spans:
        out += [text[at:start], written(text[start:end], kind, surrogate(kind, norm, key, (attempts or {}).get((kind, norm), 0)))]
        at = end
    return "".join(out) + text[at:], [x[2] for x in spans]


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, list[str]]:
    return applied(text, detect(text), key, attempts)


SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("norm", T.StringType())]))
ENTITIES = "kind string, norm string"


def with_spans(docs: DataFrame, spans_col: str, text_col: str = "text") -> DataFrame:
    """docs and a column of the entities of each text (SPANS)."""
    names = docs.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("norm", pa.string())]))
        for batch in slices(batches, text_col, 1 << 20):
            rows = [[dict(zip(("s", "e", "kind", "norm"), x, strict=True)) for x in detect(t)] if t else [] for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*names, spans_col])

    return docs.mapInArrow(find, T.StructType([*docs.schema.fields, T.StructField(spans_col, SPANS)]))


def collisions(found: DataFrame, key: bytes, most_rounds: int = 100) -> DataFrame | None:
    """(kind, norm, attempt) of the entities that need another permutation than the first; None if there are none.

    Goes on until no surrogate is used twice or an original; entities that most_rounds leave get FULL.
    """

    @F.pandas_udf("string")
    def of(kind: pd.Series, norm: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, n, key, a) for k, n, a in zip(kind, norm, attempt, strict=True)], dtype=object)

    # the few given names are permuted within their list, where an original is a valid surrogate
    entities = found.filter("kind <> 'given'").select("kind", "norm").distinct()
    state = stored(entities.withColumn("attempt", F.lit(0)).withColumn("new", of("kind", "norm", "attempt")), "entities")
    originals = stored(entities, "originals")
    for n in range(most_rounds + 1):
        first = state.groupBy("kind", "new").agg(F.min_by("norm", F.struct(-F.col("attempt"), "norm")).alias("keeps"), F.count("*").alias("m"))
        twice = state.join(first.filter("m > 1"), ["kind", "new"]).filter("norm <> keeps").select("kind", "norm")
        taken = state.join(originals.withColumnRenamed("norm", "new"), ["kind", "new"], "left_semi").select("kind", "norm")
        bad = stored(twice.union(taken).distinct().withColumn("bad", F.lit(1)), "bad")
        if not bad.limit(1).count():
            break
        more = F.lit(FULL) if n == most_rounds else F.col("attempt") + 1
        state = state.join(bad, ["kind", "norm"], "left").withColumn("attempt", F.when(F.col("bad").isNotNull(), more).otherwise(F.col("attempt"))).drop("bad", "new")
        state = stored(state.withColumn("new", of("kind", "norm", "attempt")), "entities")
    moved = state.filter("attempt <> 0").select("kind", "norm", "attempt")
    return moved if moved.limit(1).count() else None


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


def unused(names: list[str], name: str) -> str:
    while name in names:
        name += "_"
    return name


def key_of(spark: SparkSession) -> bytes:
    """The key that spark.proofsheet.pii.key sets; whoever has it can undo the permutations. Without the setting, a key that holds for this application only."""
    found = spark.conf.get("spark.proofsheet.pii.key", None) or spark.sparkContext.applicationId
    return hashlib.blake2b(found.encode(), digest_size=32).digest()


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text", out_col: str = "surrogates") -> DataFrame:
    """docs and a struct column `out_col` (RESULT): the text with surrogates, the types of its entities in order."""
    names = [n for n in docs.columns if n != out_col]
    docs = docs.select(*[F.col(f"`{n}`") for n in names])
    spans, how, row, same = (unused(names, n) for n in ("spans_of_texts", "how_of_texts", "row_of_texts", "same_row_of_texts"))
    docs = stored(with_spans(docs, spans, text_col), "spans")
    moved = collisions(docs.select(F.explode(spans).alias("x")).select("x.kind", "x.norm"), key)
    if moved is not None:
        # only rows that hold an exception; a text's exceptions are no more than its own entities
        docs = docs.withColumn(row, F.monotonically_increasing_id())
        found = docs.filter(F.size(spans) > 0).select(F.col(row).alias(same), F.explode(spans).alias("x")).select(same, "x.kind", "x.norm").distinct()
        per_row = found.join(moved, ["kind", "norm"]).groupBy(same).agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias(how))
        some = docs.filter(F.size(spans) > 0).join(per_row, F.col(row) == F.col(same), "left").select(*[F.col(f"`{n}`") for n in names], spans, how)
        docs = some.unionByName(docs.filter(F.size(spans) == 0).drop(row).withColumn(how, F.lit(None).cast(some.schema[how].dataType)))
    schema = T.StructType([*[docs.schema[n] for n in names], T.StructField(out_col, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            texts, found = batch.column(text_col).to_pylist(), batch.column(spans).to_pylist()
            ways = batch.column(how).to_pylist() if how in batch.schema.names else [None] * len(texts)
            rows = []
            for t, at, x in zip(texts, found, ways, strict=True):
                attempts = {(r["kind"], r["norm"]): r["attempt"] for r in x} if x else None
                rows.append((None, []) if t is None else applied(t, [tuple(y.values()) for y in at], key, attempts) if at else (t, []))
            new = pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=RESULT.names)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], new], names=[*names, out_col])

    return docs.mapInArrow(run, schema)
