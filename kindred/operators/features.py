"""Pair features as expressions over the columns of both records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import strings as st

#: For each family the normalised column its token set comes from.
SETS = {"nm": "n_core", "ad": "a_tokens", "st": "a_street", "num": "a_nums"}


def token_set(text: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "")))


def weighted_set(rows: DataFrame, tokens: str, idf: DataFrame, out: str, key: str = "id") -> DataFrame:
    """key, out: map from token to idf, so that overlaps need no further join."""
    each = rows.select(key, F.explode(tokens).alias("token")).join(idf.select("token", "idf"), "token")
    return each.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "idf")))).alias(out))


def set_overlap(a: Column, b: Column, prefix: str) -> list[Column]:
    """Ten columns from two maps of token to idf (null counts as empty); ratios are null where their base is 0."""
    none = F.expr("map_from_arrays(array_remove(array(''), ''), filter(array(0.0D), x -> x > 1))")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    ka, kb = F.map_keys(a), F.map_keys(b)
    total = lambda m, keys: F.aggregate(keys, F.lit(0.0), lambda s, t: s + F.element_at(m, t))
    na, nb, common = F.size(ka), F.size(kb), F.array_intersect(ka, kb)
    nc, wa, wb, wc = F.size(common), total(a, ka), total(b, kb), total(a, common)
    only_a, only_b = F.array_except(ka, kb), F.array_except(kb, ka)
    most = F.coalesce(F.array_max(F.transform(only_a, lambda t: F.element_at(a, t))), F.lit(0.0))
    ratio = lambda x, y: F.when(y > 0, x / y)
    named = {
        "jac": ratio(nc, na + nb - nc), "cont_a": ratio(nc, na), "cont_b": ratio(nc, nb), "idf_jac": ratio(wc, wa + wb - wc),
        "idf_cont_a": ratio(wc, wa), "max_idf_unmatched_a": F.when(na > 0, most), "sum_idf_unmatched_b": F.when(nb > 0, total(b, only_b)),
        "n_common": nc, "n_a": na, "n_b": nb,
    }
    return [v.cast("double").alias(f"{prefix}_{k}") for k, v in named.items()]


def house_number(a: Column, b: Column, raw_a: Column, raw_b: Column, suffix_a: Column, suffix_b: Column, unit_a: Column, unit_b: Column) -> list[Column]:
    number = lambda c: F.when(c.rlike("^[0-9]{1,11}$"), c.cast("long"))
    x, y = number(a), number(b)
    both = x.isNotNull() & y.isNotNull()
    gap = F.abs(x - y)
    related = (a != b) & (a.startswith(b) | b.startswith(a) | a.endswith(b) | b.endswith(a))
    return [
        F.when(both, 0).when(x.isNull() & y.isNull(), 3).when(x.isNull(), 2).otherwise(1).cast("double").alias("hn_state"),
        st.equal_or_missing(raw_a, raw_b).alias("hn_raw_eq"),
        F.log1p(gap.cast("double")).alias("hn_absdiff_log"),
        (gap <= 5).cast("double").alias("hn_close"),
        F.when(both, st.levenshtein_similarity(a, b)).alias("hn_digit_sim"),
        F.when(both, related.cast("double")).alias("hn_prefix"),
        st.equal_or_missing(suffix_a, suffix_b).alias("hn_suffix_eq"),
        st.equal_or_missing(unit_a, unit_b).alias("unit_eq"),
    ]


def suffix_relation(a: Column, b: Column) -> Column:
    """0 same, 1 different, 2 one missing, 3 both missing."""
    return F.when((a == "") & (b == ""), 3).when((a == "") | (b == ""), 2).when(a == b, 0).otherwise(1)


def best_over_variants(scorer, left: list[Column], right: list[Column]) -> Column:
    """The largest score over pairs of non-empty variants, null where there is none: greatest() skips null."""
    scores = [scorer(st.blank_as_null(a), st.blank_as_null(b)) for a in left for b in right]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def pair_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """All features of candidate pairs.

    s1 and pool: id and the normalised columns, with a map of token to idf named m_nm, m_ad, m_st and m_num, and on s1
    the key frequencies.  Both are joined once; everything else is a projection.
    """
    a = s1.select(F.col("id").alias("s1"), *[F.col(c).alias(f"a_{c}") for c in s1.columns if c != "id"])
    b = pool.select(F.col("id").alias("cand"), *[F.col(c).alias(f"b_{c}") for c in pool.columns if c != "id"])
    counts = pairs.groupBy("s1").agg(F.count(F.lit(1)).alias("n_cands"))
    j = pairs.join(counts, "s1").join(a, "s1").join(b, "cand")
    x, y = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    jw, tset, tsort, part = (st.scorer(k) for k in ("jaro_winkler", "token_set", "token_sort", "partial"))
    here = lambda c: (x(c) != "").cast("double")
    cols = [F.col(c) for c in pairs.columns]
    for p in SETS:
        cols += set_overlap(x(f"m_{p}"), y(f"m_{p}"), p)
    cols += [((x("n_key") == y("n_key")) & (x("n_key") != "")).cast("double").alias("key_eq"), (x("n_core") == y("n_core")).cast("double").alias("core_eq")]
    cols += [st.equal_or_missing(x(c), y(c)).alias(n) for c, n in (("a_city", "city_eq"), ("a_state", "state_eq"), ("a_postcode", "pc_eq"), ("a_hn", "hn_eq"))]
    cols += [here("a_hn").alias("hn_present_s1"), (y("a_hn") != "").cast("double").alias("hn_present_c")]
    cols += [y(c).cast("double").alias(n) for c, n in (("a_empty", "cand_addr_empty"), ("source", "cand_source"), ("n_script", "cand_script"), ("n_is_domain", "cand_is_domain"), ("n_oov", "cand_oov"), ("n_has_alias", "cand_has_alias"), ("a_landmark", "cand_landmark"), ("n_ntok", "cand_ntok"), ("a_ncomp", "cand_ncomp"))]
    cols += [x(c).alias(c) for c in ("nk_cnt_country", "nk_cnt_city", "nk_cnt_pool_city")]
    cols += [x("n_ntok").cast("double").alias("s1_ntok"), x("a_ncomp").cast("double").alias("s1_ncomp"), F.col("n_cands"), F.log1p("n_cands").alias("log_n_cands")]
    cols += [(F.least(x("n_ntok"), y("n_ntok")) / F.greatest(x("n_ntok"), y("n_ntok"), F.lit(1))).alias("ntok_ratio")]
    cols += [suffix_relation(x("n_suffix"), y("n_suffix")).cast("double").alias("suffix_rel")]
    cols += house_number(x("a_hn"), y("a_hn"), x("a_hn_raw"), y("a_hn_raw"), x("a_hn_suffix"), y("a_hn_suffix"), x("a_unit"), y("a_unit"))
    cols += [
        tset(x("n_full"), y("n_full")).alias("nm_tsr"), tsort(x("n_core"), y("n_core")).alias("nm_tsort"), part(x("n_core"), y("n_core")).alias("nm_partial"),
        jw(x("n_core"), y("n_core")).alias("nm_jw"), st.levenshtein_similarity(x("n_core"), y("n_core")).alias("nm_lev"),
        st.levenshtein_similarity(x("n_raw_core"), y("n_raw_core")).alias("nm_raw_lev"), st.levenshtein_similarity(x("n_concat"), y("n_concat")).alias("nm_concat_lev"),
        part(x("n_concat"), y("n_concat")).alias("nm_concat_partial"),
        best_over_variants(tset, [x("n_core"), x("n_alt1")], [y("n_core"), y("n_alt1"), y("n_alt2")]).alias("nm_alt_tsr"),
        best_over_variants(jw, [x("n_core"), x("n_alt1")], [y("n_core"), y("n_alt1"), y("n_alt2")]).alias("nm_alt_jw"),
        jw(st.blank_as_null(x("a_street")), st.blank_as_null(y("a_street"))).alias("st_jw"), tset(st.blank_as_null(x("a_street")), st.blank_as_null(y("a_street"))).alias("st_tsr"),
        tset(st.blank_as_null(x("a_tokens")), st.blank_as_null(y("a_tokens"))).alias("ad_tsr"), jw(st.blank_as_null(x("a_city")), st.blank_as_null(y("a_city"))).alias("city_jw"),
    ]
    f = j.select(*cols)
    best = F.greatest("nm_tsr", "nm_alt_tsr")
    zero = lambda c, fill=0.0: F.coalesce(F.col(c), F.lit(fill))
    return f.withColumn("nm_leet_gain", F.col("nm_lev") - F.col("nm_raw_lev")).withColumn("nm_best_tsr", best).withColumns(
        {"x_name_addr": best / 100 * zero("ad_jac"), "x_hn_street": zero("hn_eq") * zero("st_jac"), "x_name_hn": best / 100 * zero("hn_eq", 0.5)}
    )
