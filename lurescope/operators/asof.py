"""W1 at each request's own time: as-of joins of requests with observation histories.

A union of all sides is sorted per key by time, and the last observation of each
kind is carried down to the requests that follow it: one shuffle and one sort, no
pairs of a request with every earlier observation.  A key that holds many rows is split
into time ranges of about equal rows; a range starts from the last observation of
the ranges before it, which one row per (key, range) carries over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.url import join_host
from ..session import materialize
from . import enrich

#: Rows of both sides from which a key is split, and rows of a range.
HOT_ROWS = 2_000_000
#: Bound of the list of hot keys whatever the data (it is broadcast).
MAX_HOT_KEYS = 20_000
#: Most ranges of a key.
MAX_RANGES = 1024


def _comparable(c: Column, dtype: T.DataType) -> Column:
    """Maps have no order: their sorted entries stand for them."""
    return F.array_sort(F.map_entries(c)) if isinstance(dtype, T.MapType) else c


def _cut_times(times: DataFrame, hot_rows: int) -> DataFrame | None:
    """``_hk, _cuts``: for each hot key of ``(_k, _t)``, the times at which a new range starts; None without hot keys.

    At most MAX_HOT_KEYS rows whatever the data (by the threshold), written once.
    """
    counts = times.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    total = times.count()
    threshold = max(hot_rows, total // MAX_HOT_KEYS + 1)
    hot = materialize(counts.filter(F.col("_k").isNotNull() & (F.col("_n") >= threshold)).select(F.col("_k").alias("_hk"), "_n"), "asof_hot")
    if hot.isEmpty():
        return None
    grid = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    at = (times.join(F.broadcast(hot), F.col("_k") == F.col("_hk"))  # percentiles combine map-side
               .groupBy("_hk").agg(F.first("_n").alias("_n"), F.percentile_approx("_t", grid, 10 * MAX_RANGES).alias("_p")))
    size = F.least(F.lit(MAX_RANGES), F.ceil(F.col("_n") / F.lit(hot_rows)) + 1)
    step = F.greatest(F.lit(1), F.floor(F.lit(MAX_RANGES) / size)).cast("int")
    cuts = F.array_distinct(F.filter("_p", lambda x, i: (i + 1) % step == 0))
    return materialize(at.select("_hk", cuts.alias("_cuts")), "asof_cuts")


def asof_join_all(left: DataFrame, rights: dict[str, tuple[DataFrame, list[str]]], key: str, left_time: str, right_time: str,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` with a struct for each of ``rights`` (name -> table, values): ``right_time`` and the values of the
    table's last row with the same key and a time not after the left row's (null if there is none).

    One shuffle and one sort for all of them.  Of several rows of the same key and
    time the greatest by ``values`` counts.  Left rows with a null key or time keep
    null structs; right rows with one are never seen.  Repeated left rows are kept.
    """
    l_row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    l = left.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{left_time}`").cast("timestamp").alias("_t"), l_row.alias("_l"))
    seen: dict[str, DataFrame] = {}
    for name, (right, values) in rights.items():
        types = {f.name: f.dataType for f in right.schema.fields}
        v = F.struct(F.col(f"`{right_time}`").alias("_at"), *[_comparable(F.col(f"`{c}`"), types[c]).alias(c) for c in values])
        # one row per (key, time): repeated observations combine before the shuffle of the join
        seen[name] = (right.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{right_time}`").isNotNull())
                           .groupBy(F.col(f"`{key}`").alias("_k"), F.col(f"`{right_time}`").cast("timestamp").alias("_t"))
                           .agg(F.max(v).alias(f"_v_{name}")))
    columns = [f"_v_{n}" for n in seen]
    times, observed = l.select("_k", "_t"), None
    for r in seen.values():
        times = times.unionByName(r.select("_k", "_t"))
        observed = r if observed is None else observed.unionByName(r, allowMissingColumns=True)
    rows = l.unionByName(observed, allowMissingColumns=True)
    cuts = _cut_times(times, hot_rows)
    by = ["_k"]
    if cuts is not None:
        by = ["_k", "_b"]
        rows = _with_range(rows, cuts).unionByName(_carried(_with_range(observed, cuts), cuts, columns), allowMissingColumns=True)
    # nulls first: a carried row opens its range; at the same time observations precede requests
    order = Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first(), F.col("_l").isNotNull())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select("_k", "_t", "_l", *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns]).filter(F.col("_l").isNotNull())
    usable = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    found = []
    for name, (right, values) in rights.items():
        maps = {f.name for f in right.schema.fields if isinstance(f.dataType, T.MapType)}
        v = F.col(f"_v_{name}")
        fields = [v["_at"].alias(right_time)] + [(F.map_from_entries(v[c]) if c in maps else v[c]).alias(c) for c in values]
        found.append(F.when(usable & v.isNotNull(), F.struct(*fields)).alias(name))
    return out.select(*[F.col(f"_l.`{c}`").alias(c) for c in left.columns], *found)


def _with_range(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``_b``: the number of the key's range that the row's time is in (0 where a key isn't split)."""
    b = F.when(F.col("_cuts").isNull() | F.col("_t").isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col("_t"))))
    return rows.join(F.broadcast(cuts), F.col("_k") == F.col("_hk"), "left").withColumn("_b", b.cast("int")).drop("_hk", "_cuts")


def _carried(observed: DataFrame, cuts: DataFrame, columns: list[str]) -> DataFrame:
    """For each range of a hot key, a row with the newest observations of the ranges before it."""
    ends = (observed.join(F.broadcast(cuts.select("_hk")), F.col("_k") == F.col("_hk")).groupBy("_k", "_b")
                    .agg(*[F.max(c).alias(c) for c in columns]))
    grid = cuts.select(F.col("_hk").alias("_k"), F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_b"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most MAX_RANGES rows a key
    return grid.join(ends, ["_k", "_b"], "left").select("_k", "_b", *[F.max(c).over(before).alias(c) for c in columns])


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str],
              name: str = "seen", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``asof_join_all`` with one table."""
    return asof_join_all(left, {name: (right, values)}, key, left_time, right_time, hot_rows)


def dns_answer_sets(dns_records: DataFrame) -> DataFrame:
    """``domain, observed_at`` and the answer set of that observation (distinct records; hosts without answers have a row
    of another ``rtype``)."""
    rt = F.upper(F.col("rtype"))
    recs = dns_records.select(F.lower("domain").alias("domain"), "observed_at", rt.alias("rtype"), "rdata").distinct()
    return recs.groupBy("domain", "observed_at").agg(
        F.count_if(F.col("rtype") == "A").cast("int").alias("a"), F.count_if(F.col("rtype") == "AAAA").cast("int").alias("aaaa"),
        F.count_if(F.col("rtype") == "MX").cast("int").alias("mx"))


def enrich_at_request_time(requests: DataFrame, dns_records: DataFrame | None = None, whois_records: DataFrame | None = None,
                           tls_observations: DataFrame | None = None, domain_col: str = "domain", ts_col: str = "ts",
                           hot_rows: int = HOT_ROWS) -> DataFrame:
    """J6 with one as-of per request: every request sees the last DNS answer set, WHOIS record and TLS observation
    that were made by its own time; ages and days to expiry count from that time."""
    out = requests.withColumn("_jh", join_host(F.col(f"`{domain_col}`")))

    def lowered(df):
        return df.withColumn("domain", F.lower("domain")).withColumnRenamed("domain", "_jh")

    rights = {}
    if dns_records is not None:
        rights["_dns"] = lowered(dns_answer_sets(dns_records)), ["a", "aaaa", "mx"]
    if whois_records is not None:
        rights["_who"] = lowered(whois_records), ["creation_date", "registrars", "org"]
    if tls_observations is not None:
        rights["_tls"] = lowered(tls_observations), ["status", "issuer", "subject", "not_after"]
    if not rights:
        return requests
    out = asof_join_all(out, rights, "_jh", ts_col, "observed_at", hot_rows)
    at = F.col(f"`{ts_col}`").cast("timestamp")
    cols: dict[str, Column] = {}
    if dns_records is not None:
        a = F.col("_dns")
        cols |= {"dns_resolves": F.coalesce(a["a"] + a["aaaa"] > 0, F.lit(False)), "dns_a_record_count": F.coalesce(a["a"], F.lit(0)),
                 "dns_has_aaaa": F.coalesce((a["aaaa"] > 0).cast("int"), F.lit(0)), "dns_has_mx": F.coalesce((a["mx"] > 0).cast("int"), F.lit(0))}
    if whois_records is not None:
        types = {f.name: f.dataType for f in whois_records.schema.fields}
        w = enrich.whois_fields({c: F.col("_who")[c] for c in ("creation_date", "registrars", "org")}, types, at)
        cols |= {"whois_found": F.coalesce(w["whois_found"].cast("int"), F.lit(0)), "whois_domain_age_days": w["whois_domain_age_days"],
                 "whois_registrar": w["whois_registrar"], "whois_recently_registered": F.coalesce(w["whois_recently_registered"].cast("int"), F.lit(0)),
                 "whois_privacy_protected": F.when(F.col("_who").isNotNull(), w["whois_privacy_protected"].cast("int")).otherwise(0)}
    if tls_observations is not None:
        s = enrich.tls_fields({c: F.col("_tls")[c] for c in ("status", "issuer", "subject", "not_after")}, at)
        cols |= {"ssl_valid": s["ssl_valid"], "ssl_self_signed": s["ssl_self_signed"].cast("int"), "ssl_issuer": s["ssl_issuer"],
                 "ssl_days_until_expiry": s["ssl_days_until_expiry"], "ssl_expired": s["ssl_expired"]}
    return out.select(*[F.col(f"`{c}`") for c in requests.columns], *[c.alias(n) for n, c in cols.items()])
