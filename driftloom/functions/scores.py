"""Scores of single rows and pairs as column arithmetic. A null argument gives null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and limits that decide the results.
DISTANCE_WEIGHTS = {"token": 0.3, "ast": 0.25, "module": 0.25, "git": 0.2}
DISTANCE_SCALES = {"token": 1000.0, "ast": 100.0, "module": 10.0, "git": 1.0}
TAD_PENALTY, BOUNDARY_SHARE, LEAST_PENALTY = 0.7, 0.3, 0.1
CONTACT_TYPES = {"direct_call": 1.0, "inheritance": 0.8, "import": 0.6, "shared_data": 1.2, "exception_flow": 0.4}
THRASH_NAMES = ("__init__", "process", "handle", "setup", "configure")


def polymer_distance(parts: dict[str, Column]) -> Column:
    """Weighted sum of the distances of each kind, each divided by its scale and cut at 1."""
    total = F.lit(0.0)
    for kind, value in parts.items():
        total = total + F.lit(DISTANCE_WEIGHTS[kind]) * F.least(F.lit(1.0), value / F.lit(DISTANCE_SCALES[kind]))
    return total


def tad_penalty(domain_a: Column, domain_b: Column, strength_a: Column, strength_b: Column) -> Column:
    """1 inside one domain, 0.7 if either is unknown, else 0.7 (1 - 0.3 strongest boundary), 0.1 at least."""
    across = F.greatest(F.lit(LEAST_PENALTY), TAD_PENALTY * (1 - BOUNDARY_SHARE * F.greatest(strength_a, strength_b)))
    return F.when(domain_a.isNull() | domain_b.isNull(), TAD_PENALTY).when(domain_a == domain_b, 1.0).otherwise(across)


def contact(distance: Column, penalty: Column, kappa: float = 1.0, alpha: float = 1.2, epsilon: float = 1e-6) -> Column:
    """min(1, kappa (distance + epsilon) ** -alpha) x penalty."""
    return F.least(F.lit(1.0), kappa * F.pow(distance + epsilon, F.lit(-alpha))) * penalty


def spatial_distance(path_a: Column, path_b: Column, kind: Column, file: float = 1.0, module: float = 2.0, package: float = 4.0) -> Column:
    """Weights of unequal path, stem and folder, times the weight of the kind of contact."""
    stem = lambda p: F.regexp_replace(F.regexp_extract(p, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    folder = lambda p: F.regexp_extract(p, r"([^/]*)/[^/]*$", 1)
    unequal = lambda f, w: F.when(f(path_a) != f(path_b), w).otherwise(0.0)
    factor = F.lit(1.0)
    for name, weight in CONTACT_TYPES.items():
        factor = F.when(kind == name, weight).otherwise(factor)
    return (unequal(lambda p: p, file) + unequal(stem, module) + unequal(folder, package)) * factor


def is_contact_violation(observed: Column, expected: Column, limit: float = 2.0) -> Column:
    """Whether the logarithm of observed by expected lies beyond a limit; false unless both are above 0."""
    return F.coalesce((observed > 0) & (expected > 0) & (F.abs(F.ln(observed / expected)) > limit), F.lit(False))


def match_confidence(vector: Column, skeleton: Column, exact: Column) -> Column:
    """1 for exact matches, else 0.6 vector + 0.4 skeleton similarity, a tenth more above 0.95 and 0.9, 1 at most."""
    mixed = 0.6 * vector + 0.4 * skeleton
    return F.when(exact, 1.0).when((vector > 0.95) & (skeleton > 0.9), F.least(F.lit(1.0), 1.1 * mixed)).otherwise(mixed)


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """(value - mean) / deviation; 0 without a deviation."""
    return F.when(F.coalesce(deviation, F.lit(0.0)) == 0, 0.0).otherwise((value - mean) / deviation)


def significant(p: Column, q: Column, alpha: float = 0.05) -> Column:
    """Whether the corrected value, or the plain one where that is null, is below alpha; false if both are null."""
    return F.coalesce(F.coalesce(q, p) < alpha, F.lit(False))


def structure_similarity(hash_a: Column, hash_b: Column, counts: list[tuple[Column, Column]]) -> Column:
    """1 for equal hashes, else the mean of 1 - |a - b| / greater over pairs of counts (1 where both are 0)."""
    near = [F.when(F.greatest(a, b) == 0, 1.0).otherwise(1 - F.abs(a - b) / F.greatest(a, b)) for a, b in counts]
    return F.when(hash_a == hash_b, 1.0).otherwise(sum(near, F.lit(0.0)) / len(near))


def thrash_severity(similarity: Column, lines: Column, name: Column, threshold: float = 0.7) -> Column:
    """2 + 2 (similarity - threshold) + min(lines / 100, 1), 0.5 more for common names, 5 at most."""
    bonus = F.when(name.isin(*THRASH_NAMES), 0.5).otherwise(0.0)
    return F.least(F.lit(5.0), 2.0 + 2.0 * (similarity - threshold) + F.least(lines / 100.0, F.lit(1.0)) + bonus)


def thrash_prediction(impact: Column, complexity: Column, confidence: Column) -> Column:
    """A struct: reduction, risk, roi and priority of a fix."""
    reduction = impact * (1 - 0.5 * complexity) * confidence
    risk = complexity * (1 - confidence)
    roi = reduction / (complexity + 0.1) * confidence
    priority = F.when((roi > 2.0) & (risk < 0.3), "High").when((roi > 1.0) | (risk < 0.5), "Medium").otherwise("Low")
    return F.struct(F.round(reduction, 4).alias("reduction"), F.round(risk, 4).alias("risk"), F.round(roi, 4).alias("roi"), priority.alias("priority"))


def replication_timing(churn: Column, coverage: Column, reach: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    """A struct: the weighted timing score, and whether the module is early (churn > 0.6, coverage > 0.5, reach > 0.4)."""
    score = weights[0] * churn + weights[1] * coverage + weights[2] * reach
    return F.struct(F.round(score, 6).alias("score"), ((churn > 0.6) & (coverage > 0.5) & (reach > 0.4)).alias("early"))


def risk_grade(score: Column, limits: tuple[float, float, float] = (0.3, 0.6, 0.8)) -> Column:
    """LOW, MEDIUM, HIGH or CRITICAL by three limits."""
    low, medium, high = limits
    return F.when(score < low, "LOW").when(score < medium, "MEDIUM").when(score < high, "HIGH").otherwise("CRITICAL")


def chain_confidence(commits: Column, patterns: Column, short: Column) -> Column:
    """0.6, and 0.1 each for 5 commits, 10 commits, 3 patterns and a span of hours, 0.95 at most."""
    add = lambda rule: F.when(rule, 0.1).otherwise(0.0)
    return F.least(F.lit(0.95), 0.6 + add(commits >= 5) + add(commits >= 10) + add(patterns >= 3) + add(short))


def fragmentation_risk(members: Column, cohesion: Column, pattern: Column) -> Column:
    """0.3 min(members / 10, 1) + 0.2 (1 - cohesion) + 0.5 pattern."""
    return 0.3 * F.least(members / 10.0, F.lit(1.0)) + 0.2 * (1 - cohesion) + 0.5 * pattern


def import_anxiety(unused: Column, wildcard: Column, redundant: Column, over: Column) -> Column:
    """0.5 unused + 1.5 wildcard + 1 redundant + 0.8 over-imported."""
    return 0.5 * unused + 1.5 * wildcard + redundant + 0.8 * over


def log_bucket(n: Column) -> Column:
    """0 up to zero, 1, 2, else 2^~ and the floor of the binary logarithm."""
    return F.when(n <= 0, "0").when(n <= 2, n.cast("string")).otherwise(F.concat(F.lit("2^~"), F.floor(F.log2(n.cast("double"))).cast("string")))
