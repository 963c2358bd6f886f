"""AS-path functions over ARRAY<BIGINT> (index 0 = collector side, last = origin)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ip import let

# Networks treated as the transit-free core.
TIER1 = (174, 701, 702, 1239, 1299, 2828, 2914, 3257, 3320, 3356, 3491, 5511, 6453, 6461,
         6762, 6830, 6939, 7018, 7473, 12956, 1273, 3549, 3551, 209)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_tier1(asn, tier1: Sequence[int] = TIER1) -> Column:
    return _c(asn).isin(*tier1)


def path_array(text) -> Column:
    """'a b c' -> ARRAY<BIGINT>; NULL for a blank text."""
    t = F.trim(_c(text))
    return F.when(t != "", F.transform(F.split(t, r"\s+"), lambda x: x.try_cast("bigint")))


def path_text(path) -> Column:
    return F.array_join(_c(path).cast("array<string>"), " ")


def padded(text) -> Column:
    """' a b c ': the form the pattern predicates look at."""
    return F.concat(F.lit(" "), _c(text), F.lit(" "))


def path_clean(path) -> Column:
    """Collapse consecutive repeats, keep the order."""
    p = _c(path)
    return F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1)))


def path_origin(path) -> Column:
    return F.try_element_at(_c(path), F.lit(-1))


def path_len(path) -> Column:
    """Length with prepends, as route selection sees it."""
    return F.size(_c(path))


def _run_starts(p: Column) -> Column:
    idx = F.transform(p, lambda x, i: F.when((i == 0) | (x != F.get(p, i - 1)), i))
    return F.filter(idx, lambda i: i.isNotNull())


def path_tokens(path) -> Column:
    """Run-length tokens ARRAY<STRUCT<asn, rep, at>>; ``at`` is the position of the run."""
    def tokens(p: Column) -> Column:
        return let(_run_starts(p), lambda starts: F.transform(starts, lambda s, j: F.struct(
            F.get(p, s).alias("asn"),
            (F.coalesce(F.get(starts, j + 1), F.size(p)) - s).alias("rep"),
            s.alias("at"))))

    return let(_c(path), tokens)


def strip_feeder(path, collector, feeder_collector: str, feeder_asn: int) -> Column:
    """Drop a private first hop that one collector adds to every path."""
    p = _c(path)
    hit = (_c(collector) == feeder_collector) & (F.get(p, 0) == feeder_asn)
    return F.when(hit, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)


def path_contains_seq(path, seq: Sequence[int]) -> Column:
    """True when ``seq`` occurs as a contiguous run; an empty one always does."""
    p = _c(path)
    if not seq:
        return F.lit(True)
    want = F.array(*[F.lit(int(a)).cast("bigint") for a in seq])
    m = len(seq)
    return (F.size(p) >= m) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.size(p) - (m - 1), F.lit(1))),
        lambda i: F.slice(p, i, m) == want)


def trunc_to_tier1(path, tier1: Sequence[int] = TIER1) -> Column:
    """Cut everything before the first tier-1; without one drop the first hop."""
    p = _c(path)
    core = F.array(*[F.lit(int(a)).cast("bigint") for a in tier1])
    first = F.array_min(F.filter(F.transform(p, lambda x, i: F.when(F.array_contains(core, x), i + 1)),
                                 lambda i: i.isNotNull()))
    return (F.when(first.isNotNull(), F.slice(p, first, F.size(p)))
            .when(F.size(p) > 1, F.slice(p, 2, F.size(p))).otherwise(p))


def upstream_of_origin(path) -> Column:
    """The AS before the origin, skipping origin repeats; NULL when there is none."""
    p = _c(path)
    o = path_origin(p)
    others = F.filter(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: x != o)
    return F.try_element_at(others, F.lit(-1))


def tier1_hops(path, tier1: Sequence[int] = TIER1) -> Column:
    return F.filter(_c(path), lambda x: x.isin(*tier1))


def distance_nodes(path) -> Column:
    """Origin-first nodes ARRAY<STRUCT<asn, d>>: d counts prepends, a run is one node."""
    return F.transform(path_tokens(F.reverse(_c(path))), lambda t: F.struct(
        t["asn"].alias("asn"), t["at"].alias("d")))


def distance_edges(path) -> Column:
    """ARRAY<STRUCT<au, du, av, dv, span>> from upstream (u) to the origin side (v)."""
    pairs = let(distance_nodes(path), lambda n: F.transform(
        n, lambda v, j: F.struct(v.alias("v"), F.get(n, j + 1).alias("u"))))
    return F.transform(F.filter(pairs, lambda e: e["u"].isNotNull()), lambda e: F.struct(
        e["u"]["asn"].alias("au"), e["u"]["d"].alias("du"), e["v"]["asn"].alias("av"), e["v"]["d"].alias("dv"),
        (e["u"]["d"] - e["v"]["d"]).alias("span")))


# ---- path patterns ----------------------------------------------------------

@dataclass(frozen=True)
class PathQuery:
    """A parsed pattern: '1299 * 4538', '?' one hop, '??' two, '!N' or '-N' excludes.

    ``stretches`` are runs of hops without a gap of any length between them, None standing for any
    one hop; the gaps lie between the stretches.
    """

    stretches: tuple[tuple[int | None, ...], ...]
    excludes: tuple[int, ...]

    @property
    def include(self) -> bool:
        return bool(self.stretches)

    @property
    def empty(self) -> bool:
        return not self.stretches and not self.excludes

    def include_cond(self, padded_text: Column) -> Column:
        """Include test on ' a b c ': each stretch is looked for behind the one before, as early as possible."""
        def behind(hops: Column, start: Column, rest: tuple) -> Column:
            if not rest:
                return start.isNotNull()
            here = rest[0]
            last = F.size(hops) - len(here)

            def fits(i: Column) -> Column:
                out = F.lit(True)
                for k, asn in enumerate(here):
                    if asn is not None:
                        out = out & (F.get(hops, i + k) == str(asn))
                return out

            first = F.when(start <= last, F.get(F.filter(F.sequence(start, F.greatest(start, last)), fits), 0))
            return let(first + len(here), lambda after: behind(hops, after, rest[1:]))

        if not self.stretches:
            return F.lit(True)
        return F.coalesce(let(F.split(F.trim(padded_text), " "), lambda hops: behind(hops, F.lit(0), self.stretches)), F.lit(False))

    def cond(self, padded_text: Column) -> Column:
        """Include and every exclusion, on one single path."""
        out = self.include_cond(padded_text)
        for x in self.excludes:
            out = out & ~padded_text.contains(f" {x} ")
        return out


def path_query_parse(text: str) -> PathQuery:
    """Words are AS numbers, '*' (any gap), '?' (one hop each), '!N' or '-N' (excluded); others are ignored.

    In a run of wildcards any '*' makes a gap, else the hops add up. Wildcards at either end say nothing.
    """
    stretches: list[list[int | None]] = []
    excludes: list[int] = []
    gap, hops = False, 0
    for word in (text or "").replace("->", " ").replace(",", " ").split():
        if word.isascii() and word.isdigit():
            if not stretches or gap:
                stretches.append([int(word)])
            else:
                stretches[-1] += [None] * hops + [int(word)]
            gap, hops = False, 0
        elif word.strip("*") == "":
            gap = True
        elif word.strip("?") == "":
            hops += len(word)
        elif word[0] in "!-" and word[1:].isascii() and word[1:].isdigit():
            excludes.append(int(word[1:]))
    return PathQuery(tuple(map(tuple, stretches)), tuple(excludes))


def path_match(text, query: str | PathQuery) -> Column:
    q = path_query_parse(query) if isinstance(query, str) else query
    return q.cond(padded(text))


def match_ratio(matched, observed) -> Column:
    m, o = _c(matched), _c(observed)
    return F.when(o > 0, m.cast("double") / o).otherwise(F.lit(0.0))


def match_dominant(matched, observed) -> Column:
    """Strict majority of the observations."""
    return _c(matched) * 2 > _c(observed)
