"""Vector functions as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1.1920928955078125e-07  # float32 epsilon
UNIT_LOW, UNIT_HIGH = 0.98, 1.02  # squared norms that count as unit length


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 for empty vectors, an error where lengths differ."""
    total = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors of different length")))


def sum_squares(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(sum_squares(v))


def l2_distance_sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_distance_sq(a, b))


def is_finite(v: Column) -> Column:
    return F.forall(as_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """In [-1, 1]; 0 for empty, non-finite and zero vectors."""
    norm = l2_norm(a) * l2_norm(b)
    return F.when((F.size(a) == 0) | ~is_finite(a) | ~is_finite(b) | (norm <= EPS), F.lit(0.0)).otherwise(clamp(dot(a, b) / norm, -1.0, 1.0))


def normalised(v: Column) -> Column:
    """Unit length; vectors that are near it stay as they are, zero ones raise an error."""
    n2 = sum_squares(v)
    scaled = F.transform(as_double(v), lambda x: x / F.sqrt(n2))
    return F.when(n2 <= EPS, F.raise_error(F.lit("zero vector")).cast("array<double>")).when(n2.between(UNIT_LOW, UNIT_HIGH), as_double(v)).otherwise(scaled)


def distance(a: Column, b: Column, metric: str) -> Column:
    """cosine and inner_product: 1 - dot of normalised vectors, at least 0; euclidean: L2."""
    if metric == "euclidean":
        return l2_distance(a, b)
    if metric not in ("cosine", "inner_product"):
        raise ValueError(f"unknown metric {metric}")
    return F.greatest(F.lit(0.0), 1 - dot(normalised(a), normalised(b)))


def score(d: Column, metric: str) -> Column:
    """Similarity of a distance: the larger the nearer."""
    return 1 / (1 + F.greatest(d, F.lit(0.0))) if metric == "euclidean" else 1 - d


def quantised_hash(v: Column) -> Column:
    """Equal for vectors that agree in 16-bit steps."""
    return F.xxhash64(F.size(v), F.transform(as_double(v), lambda x: clamp(F.round(x * 32768), -32768.0, 32767.0)))


def digest(v: Column) -> Column:
    return F.xxhash64(as_double(v))


def global_id(tenant: Column, local: Column) -> Column:
    """One id of a tenant's number (below 2^31) and its own 32-bit id."""
    return F.shiftleft(tenant.cast("long"), 32).bitwiseOR(local.cast("long"))


def split_id(gid: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(gid, 32), gid.bitwiseAND(F.lit(4294967295))


RESERVED = ("__tenant_id__", "__tenant_idx__", "__namespace__")


def public_metadata(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*RESERVED))


def merged_metadata(old: Column, new: Column) -> Column:
    """Union of two maps in which new wins."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def with_reserved(m: Column, tenant_id: Column, tenant_idx: Column, namespace: Column) -> Column:
    return F.map_concat(public_metadata(m), F.create_map(F.lit(RESERVED[0]), tenant_id.cast("string"), F.lit(RESERVED[1]), tenant_idx.cast("string"), F.lit(RESERVED[2]), namespace))


def format_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        out = F.when(n >= size, F.format_string(f"%.2f {unit}", n / size)).otherwise(out)
    return out
