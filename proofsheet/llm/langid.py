"""Language identification with string kernels.

A text is the set of its 1- to 4-grams of lower-cased characters, a space before and after it
(presence, a blended spectrum), hashed to PLACES_BITS bits and kept sparse. The kernel of two
texts is the cosine of their sets. A Nystroem map over LANDMARKS training texts makes features
of it, and one ridge regression per language, against the rest, scores them. The kernel with
the landmarks, the Nystroem map and the ridge weights are one linear map of a text's places, so
they are multiplied once, and a batch is scored by the product of its sparse rows with it.
With more than FOLD languages, where that product would be large, its factors are kept apart.

Training takes a bounded sample: PER_LANG rows of each language, fewer if all need more than
TRAIN_ROWS, but LEAST_ROWS at least, by a hash of id and text; no row is moved for it, and each
reaches the driver as its places, never as text. So what the driver holds grows with the
number of languages only, and every language that has a row can be learned. Everything else
covers all rows.

A guard tells texts of no learned language: a text's letters must be known in the predicted
language, and so must be its 3- and 4-grams, less what would be found by chance. The bound
for these comes from the training texts: halves stand for each other, and languages left out
for unlearned ones. Short texts have slack, since few n-grams say little.

Defined results: null text, and text without a letter, is `und` with score 0; so is every
row if there is nothing to learn from; equal texts get equal results; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import own, slices

PLACES_BITS, GRAMS = 18, 4
PER_LANG, TRAIN_ROWS, LEAST_ROWS, LANDMARKS, RIDGE = 800, 6000, 24, 256, 1.0
#: Languages up to which the linear map is one table, and landmarks a language at least.
FOLD, LEAST_LANDMARKS = 64, 2
#: Languages up to which their numbers of rows are broadcast.
MOST_BROADCAST = 10_000
#: Rows of each language that the guard learns from, bits of a place, n-grams of a text that counts for the bound, share of known letters, slack by 1/sqrt(n-grams).
GUARD_ROWS, GUARD_BITS, GUARD_GRAMS, GUARD_LETTERS, GUARD_SLACK = 200, 22, 100, 0.5, 3.0
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
BIT = np.uint8(128) >> np.arange(8, dtype=np.uint8)
_seen = np.zeros(1 << PLACES_BITS, np.int32)


def presence(text: str) -> np.ndarray:
    """The distinct places that the text's n-grams hit."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h, all_ = c, []
    for n in range(GRAMS):
        if n:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x01000193) + c[n:]
        all_.append((h * MULTIPLIERS[n]) >> np.uint32(32 - PLACES_BITS))
    at = np.concatenate(all_)
    number = np.arange(len(at), dtype=np.int32)
    _seen[at] = number  # of equal places the last one stays
    return at[_seen[at] == number]


def packed(places: np.ndarray) -> bytes:
    """The places as bytes: as numbers, or as bits where that is less."""
    if len(places) < 1 << (PLACES_BITS - 5):
        return np.sort(places).tobytes()
    bits = np.zeros(1 << PLACES_BITS, np.bool_)
    bits[places] = True
    return np.packbits(bits).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) < 1 << (PLACES_BITS - 3):
        return np.frombuffer(raw, np.uint32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


def passages(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's letters, and the places (GUARD_BITS) of its 3- and 4-grams with a letter, as often as they occur."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (c >= 128) | (c >= 97) & (c <= 122)
    h, some, out = c, letter, []
    for n in range(1, GRAMS):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x01000193) + c[n:]
        some = some[:-1] | letter[n:]
        if n >= 2:
            x = h[some] * MULTIPLIERS[n]
            out.append(((x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - GUARD_BITS))
    return c[letter], np.concatenate(out)


class Guard:
    """The letters and n-grams of each language's sample, and the share of a text's n-grams that must be known."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        """rows: language, distinct letters and distinct places of n-grams."""
        half = self.tables(rows[::2])
        own, left = [], []
        for lang, _, places in rows[1::2]:
            if len(places) >= GUARD_GRAMS:
                own += [self.share(places, half[lang])] if lang in half else []
                left += [max(self.share(places, t) for other, t in half.items() if other != lang)] if len(half.keys() - {lang}) else []
        low, high = np.quantile(own, 0.02) if own else 0.0, np.quantile(left, 0.98) if left else 0.0
        # languages whose samples can't be told apart say nothing of unlearned ones
        self.least = (low + high) / 2 if left and high < low else low
        self.known, self.letters = self.tables(rows), {}
        self.chance = {lang: self.filled(t) for lang, t in self.known.items()}
        for lang, letters, _ in rows:
            self.letters.setdefault(lang, np.zeros(0x110000, np.bool_))[letters] = True

    @staticmethod
    def tables(rows: list) -> dict[str, np.ndarray]:
        out = {}
        for lang, _, places in rows:
            out.setdefault(lang, np.zeros(1 << GUARD_BITS, np.bool_))[places] = True
        return {lang: np.packbits(t) for lang, t in out.items()}

    @staticmethod
    def filled(table: np.ndarray) -> float:
        return float(np.bitwise_count(table).sum() / (1 << GUARD_BITS))

    @staticmethod
    def share(places: np.ndarray, table: np.ndarray, chance: float | None = None) -> float:
        """Share of the places in the table, less the overlap expected by chance."""
        filled = Guard.filled(table) if chance is None else chance
        found = np.count_nonzero(table[places >> np.uint32(3)] & BIT[places & np.uint32(7)]) / len(places)
        return float((found - filled) / (1 - filled))

    def passes(self, text: str, lang: str) -> bool:
        letters, places = passages(text)
        if lang not in self.known or not len(places):
            return lang not in self.known
        if self.letters[lang][letters].mean() < GUARD_LETTERS:
            return False
        return self.share(places, self.known[lang], self.chance[lang]) >= self.least - GUARD_SLACK / np.sqrt(len(places))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def shared(sets: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """How many of the places each of n landmarks has; sets: a bit for each landmark at each place."""
    out = np.zeros(n)
    for at in range(0, len(places), 255):  # so many bits add up in a byte
        out += np.add.reduce(np.unpackbits(sets[places[at : at + 255]], axis=1, count=n), axis=0, dtype=np.uint8)
    return out


class Model:
    """The languages, the map from places to their scores, and a guard if there is one."""

    guard: Guard | None = None

    def __init__(self, rows: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """rows: the packed places of each training text."""
        self.langs = sorted(set(langs))
        y = np.array([[1.0 if a == b else -1.0 for b in self.langs] for a in langs])
        # landmarks in turn from each language
        turn = np.zeros(len(langs), int)
        for one in self.langs:
            at = [i for i, x in enumerate(langs) if x == one]
            turn[at] = range(len(at))
        chosen = np.argsort(turn, kind="stable")[: max(landmarks, LEAST_LANDMARKS * len(self.langs))]
        sets = np.zeros((1 << PLACES_BITS, (len(chosen) + 7) // 8), np.uint8)  # a bit for each landmark
        for j, i in enumerate(chosen):
            sets[unpacked(rows[i]), j >> 3] |= 128 >> (j & 7)
        size, both = np.zeros(len(rows)), np.zeros((len(rows), len(chosen)))
        for i, raw in enumerate(rows):
            places = unpacked(raw)
            size[i], both[i] = np.sqrt(len(places)), shared(sets, places, len(chosen))
        k = both / (size[:, None] * size[chosen])
        values, vectors = np.linalg.eigh(k[chosen])
        good = values > 1e-6 * values[-1]
        nystroem = vectors[:, good] / np.sqrt(values[good])
        f = k @ nystroem
        share = ((y > 0).mean(0) + 1e-9)[None, :]
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share + 2e-9)).mean(1)  # rare languages count as much
        a = (f * weight[:, None]).T @ f + ridge * np.eye(f.shape[1])
        by_landmark = (nystroem @ np.linalg.solve(a, (f * weight[:, None]).T @ y)) / size[chosen, None]
        self.map = self.sets = None
        if len(self.langs) > FOLD:
            self.sets, self.by_landmark = sets, by_landmark
            return
        self.map = np.zeros((1 << PLACES_BITS, len(self.langs)), np.float32)
        for j, i in enumerate(chosen):
            self.map[unpacked(rows[i])] += by_landmark[j].astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        """One-versus-rest values of each language."""
        rows = [presence(t) for t in texts]
        sizes = np.array([len(r) for r in rows])
        if self.map is None:
            return np.stack([shared(self.sets, r, len(self.by_landmark)) for r in rows]) @ self.by_landmark / np.sqrt(sizes)[:, None]
        sums = np.add.reduceat(self.map[np.concatenate(rows)], np.cumsum(sizes) - sizes, axis=0)
        return sums / np.sqrt(sizes)[:, None]


def train(docs: DataFrame, guarded: bool = False) -> Model | None:
    """A model from the rows (doc_id, text, lang) given, with a guard if wanted; None if none has a language and a letter."""
    usable = own(docs, "doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    found = usable.groupBy("lang").count().collect()  # a row a language
    if not found:
        return None
    wanted = min(PER_LANG, max(LEAST_ROWS, TRAIN_ROWS // len(found)))
    top = 1 << 52

    def below(n: int) -> Column:
        """Bound of the hash that leaves about n rows of the row's language."""
        return F.least(F.lit(top), F.floor(F.lit(float(top)) * n / F.col("rows"))).cast("long")

    of_language = docs.sparkSession.createDataFrame([(r.lang, r["count"]) for r in found], "lang string, rows long")
    # so few rows go to the texts; of more languages, which no corpus of texts has, Spark chooses
    of_language = F.broadcast(of_language) if len(found) <= MOST_BROADCAST else of_language
    sample = usable.join(of_language, "lang").withColumn("u", F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(top))).filter(F.col("u") < below(wanted))
    sample = sample.withColumn("guards", F.col("u") < below(GUARD_ROWS))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for d, lang, t, g in zip(*(batch[c].to_pylist() for c in ("doc_id", "lang", "text", "guards")), strict=True):
                if has_letter(t):
                    seen = [np.unique(x).tobytes() for x in passages(t)] if guarded and g else [None, None]
                    rows.append((d, lang, packed(presence(t)), *seen))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "lang", "places", "letters", "grams"])

    # a repeated row counts once; the hash draws about `wanted` rows a language at most
    rows = sample.select("doc_id", "lang", "text", "guards").mapInArrow(places, "doc_id long, lang string, places binary, letters binary, grams binary").distinct().limit(2 * wanted * len(found)).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.places))
    model = Model([r.places for r in rows], [r.lang for r in rows])
    if guarded:
        model.guard = Guard([(r.lang, np.frombuffer(r.letters, np.uint32), np.frombuffer(r.grams, np.uint32)) for r in rows if r.grams is not None])
    return model


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("learned", T.BooleanType())])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs and a struct p_ (PREDICTED): language, its share of the softmax of all scores, whether the model's guard passes it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**PLACES_BITS numbers for each of FOLD languages, or bits for each landmark
    schema = T.StructType([*docs.schema.fields, T.StructField("p_", PREDICTED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text", 1 << 20):
            texts, n = batch.column("text").to_pylist(), batch.num_rows
            lang, score = ["und"] * n, np.zeros(n)
            learned: list[bool | None] = [None] * n
            rows = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                values = m.scores([texts[i] for i in part])
                e = np.exp(4 * (values - values.max(1, keepdims=True)))
                for i, b in zip(part, values.argmax(1), strict=True):
                    lang[i] = m.langs[b]
                score[part] = 1 / e.sum(1)
            if m is not None and m.guard is not None:
                for i in rows:
                    learned[i] = bool(m.guard.passes(texts[i], lang[i]))
            found = pa.StructArray.from_arrays([pa.array(lang), pa.array(score), pa.array(learned, pa.bool_())], names=PREDICTED.names)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "p_"])

    return docs.mapInArrow(run, schema)


def held_out(col: str = "doc_id", of: int = 4, part: int = 2):
    """crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % of == part, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from the rows not held out."""
    model = train(docs.filter(~held_out()))
    rows = own(docs, "doc_id", "text").withColumn("held_out", held_out())
    return predict(rows, model).select("doc_id", "held_out", "p_.lang_pred", "p_.score")
