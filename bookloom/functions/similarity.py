"""Title and author closeness. The cheap bands are plain expressions; only what is left needs the ratio."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from bookloom import constants as K
from bookloom.functions.pyudf import match_ratio
from bookloom.functions.text import _c, key_title


def structural_score(q, qf, c, cf) -> Column:
    """Score of the equal, folded, prefix and containment bands; null when only the ratio can tell.
    q, c are normal forms, qf, cf the same with a short subtitle folded away."""
    q, qf, c, cf = _c(q), _c(qf), _c(c), _c(cf)
    share = F.least(F.length(q), F.length(c)) / F.greatest(F.length(q), F.length(c))
    folded = ((qf != q) | (cf != c)) & ((qf == cf) | (cf == q) | (qf == c))
    return (F.when((q == "") | (c == ""), F.lit(0.0)).when(q == c, F.lit(1.0)).when(folded, F.lit(K.FOLDED_SCORE))
            .when(c.startswith(q) | q.startswith(c), K.PREFIX_BASE + K.PREFIX_SPAN * share)
            .when(c.contains(q) | q.contains(c), K.CONTAINS_BASE + K.CONTAINS_SPAN * share))


def ratio_score(ratio) -> Column:
    return F.greatest(F.lit(0.0), (_c(ratio) - K.RATIO_FLOOR) / K.RATIO_SPAN) * K.RATIO_TOP


def ratio_needed(min_score: float) -> float | None:
    """The ratio a pair needs to reach min_score, or None when the ratio band cannot reach it."""
    return K.RATIO_FLOOR + K.RATIO_SPAN * min_score / K.RATIO_TOP if min_score < K.RATIO_TOP else None


def title_similarity(q, qf, c, cf) -> Column:
    sure = structural_score(q, qf, c, cf)
    # rows a band has decided reach the ratio helper as nulls
    return F.coalesce(sure, ratio_score(match_ratio(F.when(sure.isNull(), _c(q)), F.when(sure.isNull(), _c(c)))))


def author_similarity(q, c) -> Column:
    """Of two author keys: 1 equal, 0.8 containment, else the ratio; 0 when one is empty."""
    sure = author_similarity_bands(q, c)
    return F.coalesce(sure, match_ratio(F.when(sure.isNull(), _c(q)), F.when(sure.isNull(), _c(c))))


def author_similarity_bands(q, c) -> Column:
    """author_similarity without the ratio (null there), for rules that ask for more than 0.8."""
    q, c = _c(q), _c(c)
    return (F.when((q == "") | (c == ""), F.lit(0.0)).when(q == c, F.lit(1.0))
            .when(q.contains(c) | c.contains(q), F.lit(0.8)))


def download_title_score(query, cand) -> Column:
    """1 equal, 0.95 with a known edition suffix, 0.8 prefix, else 0.6 times the share of known characters."""
    q, c = key_title(query), key_title(cand)
    tail = F.substring(c, F.length(q) + 1, F.length(c))
    edition = reduce(lambda a, b: a | b, [tail.startswith(s) for s in K.EDITION_SUFFIXES])
    common = F.aggregate(F.split(q, ""), F.lit(0),
                         lambda n, ch: n + F.when((ch != "") & c.contains(ch), 1).otherwise(0))
    return (F.when((q == "") | (c == ""), F.lit(0.0)).when(q == c, F.lit(1.0))
            .when(c.startswith(q) & edition & (F.length(tail) <= 10), F.lit(0.95))
            .when(c.startswith(q) | q.startswith(c), F.lit(0.8))
            .otherwise(0.6 * common / F.greatest(F.length(q), F.lit(1))))
