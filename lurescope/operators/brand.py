"""Brand impersonation: keyword containment, typosquat similarity, action words.

Two forms with identical results:

* ``brand_features`` (batch): typosquats are a hash equi join of exploded
  tokens against the keyword dimension banded to ``len +- 2`` (broadcast,
  fixed 425 rows) then an edit-distance filter; containment hits are a
  row-local filter over the fixed keyword array.  Only hit rows are
  shuffled to the per-domain rollup.  Run it on *distinct* domains.
* ``brand_features_rowlocal`` (streaming / no shuffle): the same rules as
  higher-order functions over the token array and a keyword array literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_round
from ..sources import dimensions as dims
from ..sources import fixed_values as FV

BRAND_COLUMNS = [
    "brand_impersonation_score", "brand_matched_count", "brand_keyword_hit_count",
    "brand_typosquat_hit_count", "brand_has_action_word",
]
BRAND_DETAIL_COLUMNS = ["matched_brands", "keyword_hits", "closest_brand", "typosquat_details"]
TYPO_DETAIL_TYPE = "array<struct<token:string,brand:string,keyword:string,distance:int>>"


def brand_tokens(domain: Column) -> Column:
    """Lower-case, drop ``http(s)://``, cut at the first ``/`` then ``:``, drop a
    leading ``www.``, split on ``.`` and ``-``, drop empty pieces."""
    d = F.regexp_replace(F.lower(domain), r"^https?://", "")
    d = F.substring_index(F.substring_index(d, "/", 1), ":", 1)
    d = F.when(d.startswith("www."), F.substring(d, 5, 1 << 30)).otherwise(d)
    return F.filter(F.split(d, r"[.\-]"), lambda t: t != "")


def has_action_word(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, dims.action_words_array())


def action_word_domains(domains: DataFrame, domain_col: str = "domain") -> DataFrame:
    """J5, relational form: the domains with at least one action-word token --
    exploded tokens left-semi joined to the fixed 21-word table (broadcast)."""
    words = F.broadcast(domains.sparkSession.range(1)
                        .select(F.explode(dims.action_words_array()).alias("token")))
    return tokenize(domains, domain_col).join(words, "token", "left_semi").select("domain").distinct()


def typosquat_weight(dist: Column) -> Column:
    return F.lit(FV.KEYWORD_HIT_WEIGHT) * (F.lit(1.0) - dist / F.lit(float(FV.MAX_TYPOSQUAT_DISTANCE + 1)))


def _score(n_kw: Column, typo_sum: Column, n_hits: Column, action: Column) -> Column:
    boost = F.when(action & (n_hits > 0), F.lit(FV.ACTION_WORD_BOOST)).otherwise(F.lit(0.0))
    raw = F.lit(FV.KEYWORD_HIT_WEIGHT) * n_kw + typo_sum + boost
    return py_round(F.least(raw, F.lit(1.0)), 4)


# ---------------------------------------------------------------- batch form

def tokenize(domains: DataFrame, domain_col: str = "domain") -> DataFrame:
    """``(domain, pos, token)``, one row per token occurrence (repeats kept)."""
    return domains.select(
        F.col(domain_col).alias("domain"),
        F.posexplode(brand_tokens(F.col(domain_col))).alias("pos", "token"))


def keyword_hits(domains: DataFrame, domain_col: str = "domain", keywords: DataFrame | None = None) -> DataFrame:
    """``(domain, brand, keyword)`` for every dictionary entry whose keyword is
    contained in the domain's tokens joined without separators.

    The fixed 85-keyword dictionary is evaluated row-local: an array literal,
    ``filter`` keeps the contained keywords and ``inline`` emits one row per hit.
    A custom dictionary of any size is an equi join (``keyword_hits_join``).
    Both give one row per entry: an entry that repeats counts each time, and an
    empty keyword is contained in every domain.
    """
    if keywords is not None:
        return keyword_hits_join(domains, keywords, domain_col)
    d = domains.select(F.col(domain_col).alias("domain"),
                       F.array_join(brand_tokens(F.col(domain_col)), "").alias("_collapsed"))
    hits = F.filter(_keyword_array(), lambda k: F.col("_collapsed").contains(k["keyword"]))
    return d.select("domain", F.inline(hits))


def keyword_hits_join(domains: DataFrame, keywords: DataFrame, domain_col: str = "domain") -> DataFrame:
    """J2 for a custom dictionary ``(brand, keyword)``: the distinct substrings of
    the collapsed text whose length is a keyword length, equi-joined to the
    keywords (the planner picks broadcast or shuffle from the dictionary's size).
    Cost grows with text length x distinct keyword lengths, not with the
    dictionary."""
    kw = keywords.select("brand", "keyword").filter("keyword is not null")
    lens = sorted(r[0] for r in kw.select(F.length("keyword")).distinct().collect())  # at most the longest keyword's length
    d = domains.select(F.col(domain_col).alias("domain"),
                       F.array_join(brand_tokens(F.col(domain_col)), "").alias("_c"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("_c"), F.lit(1)))
    # substrings cut short by the end of the text are left out
    whole = [F.filter(F.transform(starts, _substring_of(F.col("_c"), n)), _has_length(n)) for n in lens]
    subs = d.select("domain", F.explode(F.array_distinct(F.concat(*whole))).alias("_s")) if lens \
        else d.select("domain", F.lit(None).cast("string").alias("_s"))
    return subs.join(kw, F.col("_s") == F.col("keyword")).select("domain", "brand", "keyword")


def _substring_of(text: Column, n: int):
    return lambda p: F.substring(text, p, F.lit(n))


def _has_length(n: int):
    return lambda x: F.length(x) == n


def deletions(word: Column) -> Column:
    """The word and what is left of it after deleting one or two characters.

    Two words within edit distance 2 always share one of these.
    """
    once = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), _without(word))
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, _all_without))))


def _without(word: Column):
    return lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))


def _all_without(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), _without(word))


#: (length difference token - keyword, segment, shift) of the pieces of a token that can be a keyword's segment.
#: A word cut in three keeps one segment whole under two edits; with a length difference of d the
#: segment moves by at least -(2 - d) // 2 and at most (2 + d) // 2 places.
_SEGMENTS = FV.MAX_TYPOSQUAT_DISTANCE + 1
_MOVES = [{"diff": d, "seg": i, "shift": k}
          for d in range(-FV.MAX_TYPOSQUAT_DISTANCE, FV.MAX_TYPOSQUAT_DISTANCE + 1) for i in range(_SEGMENTS)
          for k in range(-((FV.MAX_TYPOSQUAT_DISTANCE - d) // 2), (FV.MAX_TYPOSQUAT_DISTANCE + d) // 2 + 1)]
_SEGMENT_KEY = ["kw_len", "diff", "seg", "piece"]


def _segment(kw_len: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` of a keyword: equal parts, the last ones a character longer."""
    part, long_from = F.floor(kw_len / _SEGMENTS), F.lit(_SEGMENTS) - kw_len % _SEGMENTS
    start = F.lit(1) + i * part + F.greatest(F.lit(0), i - long_from)
    return start.cast("int"), (part + (i >= long_from).cast("int")).cast("int")


def _characters(word: Column) -> Column:
    return F.array_distinct(F.split(word, ""))


def keyword_segments(word: Column) -> Column:
    """Keys of a keyword: each segment, for each length of a token within two edits.

    One of one or two characters has no three segments; its keys are its characters, of
    which a token of three or more characters within two edits has one.
    """
    n = F.length(word)
    diffs = dims.array_literal([{"diff": d} for d in range(-FV.MAX_TYPOSQUAT_DISTANCE, FV.MAX_TYPOSQUAT_DISTANCE + 1)])

    def keys(diff):
        cut = F.transform(F.sequence(F.lit(0), F.lit(_SEGMENTS - 1)), lambda i: F.struct(
            n.alias("kw_len"), diff["diff"].alias("diff"), i.alias("seg"), F.substring(word, *_segment(n, i)).alias("piece")))
        short = F.transform(_characters(word), lambda c: F.struct(
            n.alias("kw_len"), diff["diff"].alias("diff"), F.lit(-1).alias("seg"), c.alias("piece")))
        return F.when(n >= _SEGMENTS, cut).otherwise(short)

    return F.flatten(F.transform(diffs, keys))


def token_segments(word: Column) -> Column:
    """Keys of a token: the pieces of it that can be a segment of a keyword within two edits."""
    n = F.length(word)

    def key(m):
        kw_len = n - m["diff"]
        start, size = _segment(kw_len, m["seg"])
        at = start + m["shift"]
        fits = (kw_len >= _SEGMENTS) & (at >= 1) & (at + size - 1 <= n)
        return F.when(fits, F.struct(kw_len.alias("kw_len"), m["diff"].alias("diff"), m["seg"].alias("seg"),
                                     F.substring(word, at, size).alias("piece")))

    short = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(_SEGMENTS - 1)), lambda k: F.when(
        F.abs(n - k) <= FV.MAX_TYPOSQUAT_DISTANCE, F.transform(_characters(word), lambda c: F.struct(
            k.alias("kw_len"), (n - k).alias("diff"), F.lit(-1).alias("seg"), c.alias("piece"))))
        .otherwise(F.array().cast("array<struct<kw_len:int,diff:int,seg:int,piece:string>>"))))
    return F.array_compact(F.concat(F.transform(dims.array_literal(_MOVES), key), short))


def typosquat_hits(domains: DataFrame, domain_col: str = "domain", keywords: DataFrame | None = None) -> DataFrame:
    """``(domain, pos, token, brand, keyword, distance, weight)`` for tokens of
    length >= 3 within edit distance 1..2 of a keyword.

    The fixed dictionary is banded by length (409 rows, broadcast).  For a custom
    one, the distinct tokens and the keywords meet on a shared segment (both lengths, place
    and text of the segment are the key of an equi join), then by ``levenshtein``.
    Short words meet on single characters, but there are few distinct ones.
    """
    tok = (tokenize(domains, domain_col)
           .withColumn("_tlen", F.length("token"))
           .filter(F.col("_tlen") >= FV.MIN_TYPOSQUAT_TOKEN_LENGTH))
    if keywords is None:
        bands = F.broadcast(dims.brand_keyword_bands(domains.sparkSession)
                            .select("brand", "keyword", "ord", "band_len"))
        near = tok.join(bands, F.col("_tlen") == F.col("band_len"))
    else:
        kw = keywords.select("brand", "keyword", "ord").filter("length(keyword) > 0")
        left = tok.select("token").distinct().select("token", F.inline(token_segments(F.col("token"))))
        right = kw.select(F.col("keyword").alias("_kw")).distinct().select("_kw", F.inline(keyword_segments(F.col("_kw"))))
        pairs = (left.join(right, _SEGMENT_KEY)
                 .filter(F.levenshtein("token", "_kw", FV.MAX_TYPOSQUAT_DISTANCE).between(1, FV.MAX_TYPOSQUAT_DISTANCE))
                 .select(F.col("token").alias("_t"), "_kw").distinct())
        near = tok.join(pairs, F.col("token") == F.col("_t")).join(kw, F.col("_kw") == F.col("keyword"))
    hits = (near.withColumn("distance", F.levenshtein("token", "keyword", FV.MAX_TYPOSQUAT_DISTANCE))
                .filter(F.col("distance").between(1, FV.MAX_TYPOSQUAT_DISTANCE)))
    return hits.select("domain", "pos", "token", "brand", "keyword",
                       F.col("distance").cast("int").alias("distance"),
                       typosquat_weight(F.col("distance")).alias("weight"), F.col("ord").cast("long").alias("ord"))


def brand_features(domains: DataFrame, domain_col: str = "domain", keywords: DataFrame | None = None) -> DataFrame:
    """Per-domain brand columns (``BRAND_COLUMNS`` + ``BRAND_DETAIL_COLUMNS``).

    ``domains`` should hold distinct domains; every input row and column is kept.
    """
    d = domains.select(F.col(domain_col).alias("domain"))
    kw = keyword_hits(d, keywords=keywords).select("domain", "brand", "keyword",
                                F.lit(0).alias("distance"), F.lit(0.0).alias("weight"),
                                F.lit(True).alias("is_kw"), F.lit(None).cast("int").alias("pos"),
                                F.lit(None).cast("string").alias("token"), F.lit(None).cast("long").alias("ord"))
    ty = typosquat_hits(d, keywords=keywords).select("domain", "brand", "keyword", "distance", "weight",
                                  F.lit(False).alias("is_kw"), "pos", "token", "ord")
    rollup = (kw.unionByName(ty).groupBy("domain").agg(
        F.count_if("is_kw").cast("int").alias("_n_kw"),
        F.count_if(~F.col("is_kw")).cast("int").alias("_n_typo"),
        F.sum("weight").alias("_typo_sum"),
        F.array_sort(F.collect_set("brand")).alias("matched_brands"),
        F.array_sort(F.collect_set(F.when(F.col("is_kw"), F.col("keyword")))).alias("keyword_hits"),
        F.min(F.struct("distance", "brand")).getField("brand").alias("closest_brand"),
        # bounded per domain by tokens x keywords; token order, then dictionary order
        F.array_sort(F.collect_list(F.when(~F.col("is_kw"), F.struct(
            "pos", "ord", "token", "brand", "keyword", "distance")))).alias("_typo"),
    ))
    base = domains.withColumnRenamed(domain_col, "domain").withColumn(
        "brand_has_action_word", has_action_word(brand_tokens(F.col("domain"))).cast("int"))
    j = base.join(rollup, "domain", "left")
    n_kw = F.coalesce("_n_kw", F.lit(0))
    n_typo = F.coalesce("_n_typo", F.lit(0))
    extra = [c for c in base.columns if c not in ("domain", "brand_has_action_word")]
    return j.select(
        "domain", *extra,
        _score(n_kw, F.coalesce("_typo_sum", F.lit(0.0)), n_kw + n_typo,
               F.col("brand_has_action_word") == 1).alias("brand_impersonation_score"),
        F.coalesce(F.size("matched_brands"), F.lit(0)).cast("int").alias("brand_matched_count"),
        n_kw.alias("brand_keyword_hit_count"),
        n_typo.alias("brand_typosquat_hit_count"),
        "brand_has_action_word",
        F.coalesce("matched_brands", F.array().cast("array<string>")).alias("matched_brands"),
        F.coalesce("keyword_hits", F.array().cast("array<string>")).alias("keyword_hits"),
        "closest_brand",
        F.coalesce(F.transform("_typo", lambda h: F.struct(h["token"].alias("token"), h["brand"].alias("brand"),
                                                            h["keyword"].alias("keyword"),
                                                            h["distance"].alias("distance"))),
                   F.array().cast(TYPO_DETAIL_TYPE)).alias("typosquat_details"),
    )


# ----------------------------------------------------------- row-local form

def _keyword_array() -> Column:
    return dims.array_literal([{"brand": b, "keyword": k} for b, k, _, _ in dims.brand_keyword_rows()])


def _keywords_by_length(rows: list[tuple[str, str]]) -> Column:
    """The keywords within two characters of each token length, as an array indexed by the length (dictionary order kept)."""
    top = max((len(k) for _, k in rows), default=0) + FV.MAX_TYPOSQUAT_DISTANCE

    def near(n):
        own = [{"brand": b, "keyword": k} for b, k in rows if abs(n - len(k)) <= FV.MAX_TYPOSQUAT_DISTANCE]
        return dims.array_literal(own) if own else F.array().cast("array<struct<brand:string,keyword:string>>")

    return F.array(*[near(n) for n in range(top + 1)])


def brand_hits_rowlocal(domain: Column, keyword_rows: list[tuple[str, str]] | None = None) -> list[dict[str, Column]]:
    """What the brand columns are made of, in two steps of one row each: tokens, then keyword and typosquat hits.

    ``keyword_rows``: the caller's own (brand, keyword) list instead of the fixed one.
    """
    rows = [(b, k) for b, k, _, _ in dims.brand_keyword_rows()] if keyword_rows is None else keyword_rows
    kws = dims.array_literal([{"brand": b, "keyword": k} for b, k in rows])
    tokens = F.col("_tokens")
    by_length = _keywords_by_length(rows)

    def distance(t, k):  # -1 beyond the limit
        return F.levenshtein(t, k["keyword"], FV.MAX_TYPOSQUAT_DISTANCE)

    def token_hits(t):
        # a token has few keywords of about its length, and fewer hits: only these become rows
        near = F.filter(F.get(by_length, F.length(t)), lambda k: distance(t, k) > 0)
        return F.transform(near, lambda k: F.struct(
            t.alias("token"), k["brand"].alias("brand"), k["keyword"].alias("keyword"), distance(t, k).alias("distance")))

    long_tokens = F.filter(tokens, lambda t: F.length(t).between(FV.MIN_TYPOSQUAT_TOKEN_LENGTH, F.size(by_length) - 1))
    # the text is an array's only element, so that it is joined once and not again for each keyword
    collapsed = F.array(F.array_join(tokens, ""))
    return [{"_tokens": brand_tokens(domain)},
            {"_kw_hits": F.flatten(F.transform(collapsed, lambda c: F.filter(kws, lambda k: c.contains(k["keyword"])))),
             "_typo": F.flatten(F.transform(long_tokens, token_hits))}]


def brand_columns_rowlocal() -> dict[str, Column]:
    """The brand columns from ``_tokens``, ``_kw_hits`` and ``_typo`` of one row (no join, no shuffle)."""
    tokens, kw_hits, typo = F.col("_tokens"), F.col("_kw_hits"), F.col("_typo")
    typo_sum = F.aggregate(typo, F.lit(0.0), lambda acc, h: acc + typosquat_weight(h["distance"]))
    n_kw = F.size(kw_hits)
    n_typo = F.size(typo)
    brands = F.array_distinct(F.concat(F.transform(kw_hits, lambda k: k["brand"]),
                                       F.transform(typo, lambda h: h["brand"])))
    action = has_action_word(tokens)
    closest = F.array_min(F.concat(
        F.transform(kw_hits, lambda k: F.struct(F.lit(0).alias("distance"), k["brand"].alias("brand"))),
        F.transform(typo, lambda h: F.struct(h["distance"].alias("distance"), h["brand"].alias("brand")))))
    return {
        "brand_impersonation_score": _score(n_kw, typo_sum, n_kw + n_typo, action),
        "brand_matched_count": F.size(brands).cast("int"),
        "brand_keyword_hit_count": n_kw.cast("int"),
        "brand_typosquat_hit_count": n_typo.cast("int"),
        "brand_has_action_word": action.cast("int"),
        "matched_brands": F.array_sort(brands),
        "keyword_hits": F.array_sort(F.array_distinct(F.transform(kw_hits, lambda k: k["keyword"]))),
        "closest_brand": closest["brand"],
        "typosquat_details": F.transform(typo, lambda h: F.struct(
            h["token"].alias("token"), h["brand"].alias("brand"), h["keyword"].alias("keyword"),
            h["distance"].cast("int").alias("distance"))),
    }


def brand_features_rowlocal(df: DataFrame, domain_col: str = "domain",
                            keyword_rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """``df`` and the brand columns.  Projections in steps: Catalyst keeps them apart, as their columns are
    read several times, so tokens and hits are computed once a row and not once a column."""
    staged = df
    for step in brand_hits_rowlocal(F.col(domain_col), keyword_rows):
        staged = staged.select("*", *[c.alias(n) for n, c in step.items()])
    cols = brand_columns_rowlocal()
    return staged.select(*df.columns, *[cols[k].alias(k) for k in BRAND_COLUMNS + BRAND_DETAIL_COLUMNS])
