"""Column builders for verdicts, severities, signatures and acknowledgements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofsheet.schema import SEVERITY_RANK, VERDICT_RANK

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rank_of(c: C, ranks: dict[str, int], unknown: int = 0) -> Column:
    """The rank of a name; names that aren't listed get `unknown`."""
    pairs = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(pairs[col(c)], F.lit(unknown)).cast("int")


def severity_rank(c: C, unknown: int = 0) -> Column:
    return rank_of(c, SEVERITY_RANK, unknown)


def verdict_rank(c: C) -> Column:
    return rank_of(c, VERDICT_RANK)


def severity_name(rank: Column) -> Column:
    names = sorted(SEVERITY_RANK, key=SEVERITY_RANK.get)
    return F.element_at(F.array(*map(F.lit, names)), rank + 1)


def worst_severity(c: C) -> Column:
    """Aggregate: the worst severity; none gives NONE, unlisted names count as UNCERTAIN."""
    return severity_name(F.coalesce(F.max(F.when(col(c).isNotNull(), severity_rank(c, SEVERITY_RANK["UNCERTAIN"]))), F.lit(0)))


def worst_of(names: C) -> Column:
    """The worst severity of an array."""
    ranks = F.transform(col(names), lambda s: severity_rank(s, SEVERITY_RANK["UNCERTAIN"]))
    return severity_name(F.coalesce(F.array_max(ranks), F.lit(0)))


def decide(matched: C, current: C, matched_sha: C, current_sha: C, delta_severities: C, error: C) -> Column:
    """STRUCT<verdict, severity> of one listing."""
    same = (col(matched) == col(current)) | F.coalesce(col(matched_sha) == col(current_sha), F.lit(False))

    def out(verdict: str, severity: Column) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), severity.alias("severity"))

    uncertain = F.lit("UNCERTAIN")
    return F.when(col(error), out("ERROR", uncertain)).when(col(matched).isNull(), out("UNKNOWN_IMAGE", uncertain)).when(same, out("PASS", F.lit("NONE"))).otherwise(out("STALE_VERSION", worst_of(delta_severities)))


def region_signature(product: C, x: C, y: C, w: C, h: C, field: C) -> Column:
    """Identity of a region that a jitter of a few pixels leaves as it is: tens, half to even."""
    tens = [F.bround(col(c).cast("long"), -1).cast("long").cast("string") for c in (x, y, w, h)]
    return F.sha2(F.concat_ws("|", col(product).cast("string"), *tens, F.coalesce(col(field), F.lit(""))), 256)


def margin_confidence(best: C, runner_up: C) -> Column:
    b, r = col(best), col(runner_up)
    lead = F.when(b <= 0, F.lit(1.0)).otherwise(F.lit(0.5))
    return F.when(r <= 0, lead).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - b / r)))


def margin_gate(best: C, runner_up: C, ratio: float) -> Column:
    """Whether the winner leads by the ratio. Two totals of zero tie and are refused."""
    b, r = col(best), col(runner_up)
    return (b * F.lit(ratio) <= r) & ~((b == 0) & (r == 0))


def pair_verdict(halt: C, material: C, uncertain: C, cosmetic: C) -> Column:
    """Verdict of a compared pair: a halted stage's own, else by the worst kind of difference found."""
    return (
        F.when(col(halt).isNotNull(), col(halt))
        .when(col(material) > 0, "DIFFERENT")
        .when(col(uncertain) > 0, "NEEDS_REVIEW")
        .when(col(cosmetic) > 0, "MATCH_WITH_COSMETIC_DIFFERENCES")
        .otherwise("MATCH")
    )


def registration_confidence(inliers: C, ok: int, error: C, tolerance: float, overlap: C) -> Column:
    c = F.least(F.lit(1.0), col(inliers) / (2.0 * ok)) * F.greatest(F.lit(0.0), 1 - col(error) / tolerance) * F.least(F.lit(1.0), col(overlap) / 0.8)
    return F.bround(c, 4)


def outcome(expected: C, matched: C, expected_sha: C, matched_sha: C, errored: C) -> Column:
    """How a labelled case came out; labels of the same bytes are one."""
    same = (col(expected) == col(matched)) | F.coalesce(col(expected_sha) == col(matched_sha), F.lit(False))
    return (
        F.when(col(errored), "ERROR")
        .when(col(matched).isNull(), F.when(col(expected).isNull(), "CORRECT_REFUSAL").otherwise("REFUSED"))
        .when(F.coalesce(same, F.lit(False)), "CORRECT")
        .otherwise("WRONG")
    )


def finite6(c: C) -> Column:
    """Six decimals; values that aren't finite give null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.bround(c, 6))


def field_label(c: C) -> Column:
    """A field key as words: units in brackets, a capital first; null is an unmapped region."""
    words = F.regexp_replace(col(c), "_", " ")
    for unit, last in (("mg", ""), ("g", "$"), ("kcal", "")):
        words = F.regexp_replace(words, rf"\b{unit}\b{last}", f"({unit})")
    words = F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words)))
    return F.when(col(c).isNull() | (col(c) == ""), "Unmapped region").otherwise(words)


def label(c: C, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[col(c)]


def percent(n: C, of: C, digits: int = 0) -> Column:
    """A share as a percentage; a dash where there is nothing to share."""
    return F.when(F.coalesce(col(of), F.lit(0)) == 0, "—").otherwise(F.concat(F.format_string(f"%.{digits}f", 100.0 * col(n) / col(of)), F.lit("%")))


def duration(seconds: C) -> Column:
    """Seconds as 12s or 3m 05s; a dash for what is no duration."""
    x = col(seconds).cast("double")
    short = F.concat(F.floor(x + 0.5).cast("string"), F.lit("s"))
    long = F.concat(F.floor(x / 60).cast("string"), F.lit("m "), F.lpad(F.floor(x % 60 + 0.5).cast("string"), 2, "0"), F.lit("s"))
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0)
    return F.when(bad, "—").when(x < 60, short).otherwise(long)


def short_hash(sha: C, n: int = 10) -> Column:
    return F.when(F.coalesce(col(sha), F.lit("")) == "", "—").otherwise(F.substring(col(sha), 1, n))
