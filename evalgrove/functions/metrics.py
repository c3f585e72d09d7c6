"""Numeric and path functions on Columns: pass@k, hierarchical scores, softmax, cosine, chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "root"


def pass_at_k(n: Column, c: Column, k: Column, strict: bool = False) -> Column:
    """Chance that one of k of n answers, c of them right, is right.

    With n - c < k it is 1, which also holds for k > n with nothing right; strict gives null for k > n.
    """
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, j: acc * (1 - k / j))
    value = F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(1 - miss)
    return F.when(k <= n, value) if strict else value


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the longest common end of two arrays."""
    least = F.least(F.size(a), F.size(b))
    same = F.filter(F.sequence(F.lit(1), least), lambda i: F.slice(a, -i, i) == F.slice(b, -i, i))
    return F.when(least > 0, F.size(same)).otherwise(0)


def hierarchical(predicted: Column, reference: Column) -> Column:
    """struct(hP, hR, hF) of two leaf-to-root paths.

    The ancestor sets are the suffixes of the paths, so what they share is the longest common suffix.
    """
    both = common_suffix(predicted, reference)
    p = F.when(F.size(predicted) > 0, both / F.size(predicted)).otherwise(F.lit(0.0))
    r = F.when(F.size(reference) > 0, both / F.size(reference)).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.struct(p.alias("hP"), r.alias("hR"), f.alias("hF"))


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x))


def is_ambiguous(shares: Column, top2: float = 0.001, topk: float = 0.005) -> Column:
    """Whether the best share hardly leads the second and the last."""
    first, second, last = (F.try_element_at(shares, F.lit(i)) for i in (1, 2, -1))
    return F.coalesce((F.size(shares) >= 2) & (first - second < top2) & (first - last < topk), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cache_key(parts: Column, size: int = 12) -> Column:
    return F.substring(F.md5(F.array_join(parts, "\n")), 1, size)


def _after_first(path: Column, stops: Sequence[str]) -> Column:
    hit = F.array_position(F.transform(path, lambda x: x.isin(*stops)), True)
    return F.when(hit > 0, F.slice(path, hit.cast("int") + 1, F.greatest(F.size(path) - hit.cast("int"), F.lit(0)))).otherwise(path)


def prune_chain(chain: Column, drop_through: Sequence[str] = (), keep_from: Sequence[str] = ()) -> Column:
    """A root-first path from a leaf-first chain.

    Everything through the first node of drop_through goes; then everything before the last node of
    keep_from, if that isn't first.
    """
    path = F.reverse(chain)
    if drop_through:
        path = _after_first(path, drop_through)
    if keep_from:
        back = F.array_position(F.transform(F.reverse(path), lambda x: x.isin(*keep_from)), True).cast("int")
        at = F.size(path) - back + 1
        path = F.when((back > 0) & (at > 1), F.slice(path, F.greatest(at, F.lit(1)), F.greatest(back, F.lit(0)))).otherwise(path)
    return path


def chain_path(pruned: Column) -> Column:
    """Leaf-to-root path of a pruned root-first path."""
    return F.concat(F.reverse(pruned), F.array(F.lit(ROOT)))


def without_root(path: Column) -> Column:
    return F.when(F.try_element_at(path, F.lit(-1)) == ROOT, F.slice(path, 1, F.size(path) - 1)).otherwise(path)
