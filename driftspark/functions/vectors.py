"""Array algebra for layers: a tensor of a step is ARRAY<ARRAY<FLOAT>> (layer, hidden), computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Guards of relative norms and of cosines.
EPSILON, COSINE_EPSILON = 1e-6, 1e-8
MODES = ("concat", "last_only")


def doubles(m: Column) -> Column:
    return m.cast("array<array<double>>")


def layers(m: Column, mode: str) -> Column:
    """All layers, or the last one alone."""
    if mode not in MODES:
        raise ValueError(f"layer mode {mode!r} is not one of {MODES}")
    return m if mode == "concat" else F.slice(m, -1, 1)


def pick(m: Column, wanted: list[int]) -> Column:
    """Chosen layers of all hidden states; the first state is the embedding, so layer k is state k + 1."""
    return F.array(*[F.element_at(m, k + 2) for k in wanted])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p - q))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda s, v: s + v))


def norms(m: Column) -> Column:
    """L2 norm of each layer."""
    return F.transform(m, norm)


def relative(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x / (y + F.lit(EPSILON)))


def cosines(a: Column, b: Column) -> Column:
    """Cosine of each layer pair; 0 with a zero vector."""
    small = F.lit(COSINE_EPSILON)
    return F.zip_with(a, b, lambda x, y: dot(x, y) / (F.greatest(norm(x), small) * F.greatest(norm(y), small)))


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x))


def mean_pool(states: Column, k: int) -> Column:
    """Mean of the last k token states of each layer; states is (layer, token, hidden)."""

    def pool(tokens: Column) -> Column:
        last = F.slice(tokens, -F.least(F.lit(k), F.size(tokens)), F.least(F.lit(k), F.size(tokens)))
        zero = F.transform(F.get(last, F.lit(0)), lambda v: F.lit(0.0))
        return F.transform(F.aggregate(last, zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b)), lambda v: v / F.size(last))

    return F.transform(states, pool)


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def distance_stats(x: Column, anchors: Column) -> Column:
    """Mean, least, largest and sample deviation (null for one anchor) of the distances to all anchors.

    One fold over the distances (Welford), as an expression that a lambda names twice is computed twice.
    """
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(float("inf")).alias("low"), F.lit(float("-inf")).alias("high"))

    def step(acc: Column, v: Column) -> Column:
        n, shift = acc["n"] + 1, v - acc["mean"]
        mean = acc["mean"] + shift / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + shift * (v - mean)).alias("m2"), F.least(acc["low"], v).alias("low"), F.greatest(acc["high"], v).alias("high"))

    def finish(acc: Column) -> Column:
        return F.array(acc["mean"], acc["low"], acc["high"], F.when(acc["n"] > 1, F.sqrt(acc["m2"] / (acc["n"] - 1))))

    return F.aggregate(F.transform(anchors, lambda a: distance(x, a)), zero, step, finish)
