"""Scalar metrics on counts and keys, as column expressions."""

import math

from pyspark.sql import Column, functions as F

# The three denominators and the coefficients of the regression for eleven codens, and those for ANI above 95 %.
DENOMINATORS = ((1.0178887, 1.0135146, 1.0302181, 1.1205122), (1.0136223, 0.9803396, 1.0021964, 0.9839395), (0.9988935, 0.9690589, 0.9888171, 0.9817371))
DENOMINATORS_95 = ((1.0145656, 1.2708196, 1.2169829, 0.3904416), (0.8147527, 1.3389150, 2.0581364, -1.4624736), (1.6877678, 2.4390067, 0.7878482, 0.6697437))
COEFFICIENTS = (
    6.86905236142636, -5.85271800517096e-08, 7.43351941016881e-06, -1.95859228059721e-05, -8.44336369105416e-06, -11726.5478433625, -111109.682632437, 121000.895632267,
    -741.538955661909, -1894.53741972785, 2585.81964981999, -7744.5216892858, -18190.2514369096, 23306.3090989115, 8352.82760552325, 19782.4294837312, -25518.2493259614,
)
COEFFICIENTS_95 = (
    -1.69173585242774, -3.64716315423252e-08, 2.85880264052975e-05, -5.5597924264054e-05, -2.96208613804271e-05, 1106.96550282022, -83.197177767225, -1671.88720051458,
    152.75590068948, 212.734805232395, 208.388739816682, -0.27860125939004, 2.27065806912198, -10.2977013026837, -250.681324281127, -403.751360812353, -137.96628693833,
)
# What keeps a denominator from 0, and the line for unassembled genomes.
EPSILON = 1e-8
NAIVE_SLOPE, NAIVE_INTERCEPT = 0.1544286, 7.133e-4


def differing_bases(x: Column) -> Column:
    """The number of two-bit bases in which an XOR of packed sequences isn't zero."""
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def jaccard(shared: Column, x: Column, y: Column) -> Column:
    return shared / (x + y - shared)


def max_containment(shared: Column, x: Column, y: Column) -> Column:
    return shared / F.least(x, y)


def mash_distance(shared: Column, x: Column, y: Column, k: int) -> Column:
    """-ln(2J / (1 + J)) / k; null where nothing is shared."""
    j = jaccard(shared, x, y)
    return F.when(shared > 0, F.log((1 + j) / (2 * j)) / k)


def aaf_distance(shared: Column, x: Column, y: Column, k: int) -> Column:
    """-ln(shared / smaller size) / k; null where nothing is shared."""
    return F.when(shared > 0, F.log(1 / max_containment(shared, x, y)) / k)


def regression(xny, sections, mut2, diff, denominators, c):
    """One fit, for columns or arrays."""
    shares = [1 / (p[0] * xny + p[1] * sections + p[2] * mut2 + p[3] * diff + EPSILON) for p in denominators]
    features = [xny, sections, mut2, diff, *shares] + [f * d for d in shares for f in (xny, sections, mut2)]
    out = c[0]
    for weight, feature in zip(c[1:], features, strict=True):
        out = out + weight * feature
    return out


def regression_distance(xny: Column, diff: Column, sections: Column, mut2: Column) -> Column:
    """Distance from the context/object features by the three-denominator model, with the second fit where it is below 0.05."""
    x, d, s, m = (c.cast("double") for c in (xny, diff, sections, mut2))
    wide, close = regression(x, s, m, d, DENOMINATORS, COEFFICIENTS), regression(x, s, m, d, DENOMINATORS_95, COEFFICIENTS_95)
    return F.when(xny == 0, 1.0).when(diff == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.when(wide < 0.05, close).otherwise(wide)))


def naive_distance(xny: Column, diff: Column, sections: Column) -> Column:
    """Distance for unassembled genomes: the share of differing objects, corrected for objects that differ in several bases."""
    x, d, s = (c.cast("double") for c in (xny, diff, sections))
    whole = 1 - F.pow(1 - d / (x + d), (s + EPSILON) / (d + EPSILON))
    return F.when(xny == 0, 1.0).when(whole <= 0, 0.0).otherwise(whole * NAIVE_SLOPE + NAIVE_INTERCEPT)


# Coefficients of W. J. Cody's rational approximations (1969), numerators and denominators, highest power first.
ERF_SMALL = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346047, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _ratio(x: Column, pair: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    return _polynomial(x, pair[0]) / _polynomial(x, pair[1])


def erfc(x: Column) -> Column:
    """The complementary error function, which Spark lacks, to 15 digits; null of null."""
    y = F.abs(x)
    square = y * y
    inverse = 1 / F.greatest(square, F.lit(1.0))
    middle = F.exp(-square) * _ratio(y, ERFC_MIDDLE)
    large = F.exp(-square) / F.greatest(y, F.lit(1.0)) * (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, ERFC_LARGE))
    upper = F.when(y <= 4, middle).otherwise(large)
    return F.when(y <= 0.46875, 1 - x * _ratio(square, ERF_SMALL)).when(x < 0, 2 - upper).otherwise(upper)


def reverse_complement(kmer: Column) -> Column:
    return F.translate(F.reverse(kmer), "ACGTacgt", "TGCAtgca")


def safe_name(name: Column) -> Column:
    """Letters, digits, period, hyphen and underscore stay, all else becomes an underscore."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")
