"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written directly in DuckDB's dialect against the pre-registered base tables
(``pages``, ``events``); the fixture views are CTEs.  The fixed values come
from the same ``fixed_values`` module (they are data, not logic).
"""

from __future__ import annotations

from ..functions.text import PY_DIGIT_CLASS, PY_SPACE_CLASS
from ..functions.url import URL_SPLIT_RE
from ..operators.idn import _CONFUSABLE_CLASS
from ..sources import fixed_values as FV
from ..sources.fixtures import (AGES_AS_OF, FIXTURE_CATEGORY_RULES, LURE_MODULUS, LURES,
                                NOT_AFTER_TIMES, STATS_AS_OF)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ts(d) -> str:
    return f"TIMESTAMP '{d.strftime('%Y-%m-%d %H:%M:%S')}'"


def values(rows) -> str:
    out = []
    for r in rows:
        out.append("(" + ", ".join(q(v) if isinstance(v, str) else repr(v) for v in r) + ")")
    return "VALUES " + ", ".join(out)


# --------------------------------------------------------------- scalar SQL

def netloc(u: str) -> str:
    clean = f"regexp_replace(regexp_replace({u}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"
    return f"regexp_extract({clean}, {q(URL_SPLIT_RE)}, 2)"


def url_part(u: str, g: int) -> str:
    clean = f"regexp_replace(regexp_replace({u}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"
    return f"regexp_extract({clean}, {q(URL_SPLIT_RE)}, {g})"


def default_scheme(u: str) -> str:
    return f"(CASE WHEN contains({u}, '://') THEN {u} ELSE 'https://' || {u} END)"


def host_of(n: str) -> str:
    return f"split_part(string_split({n}, '@')[-1], ':', 1)"


def domain_key(u: str) -> str:
    return f"coalesce(nullif({netloc(default_scheme(u))}, ''), {u})"


def py_round(x: str, places: int) -> str:
    return f"CAST(printf('%.{places}f', {x}) AS DOUBLE)"


def nchar(s: str, ch: str) -> str:
    return f"(length({s}) - length(replace({s}, {q(ch)}, '')))"


def nclass(s: str, cls: str) -> str:
    return f"(length({s}) - length(regexp_replace({s}, {q(cls)}, '', 'g')))"


def entropy(h: str) -> str:
    share = f"(length({h}) - length(replace({h}, c, '')))::DOUBLE / length({h})"
    return (f"(CASE WHEN length({h}) = 0 THEN 0.0::DOUBLE ELSE "
            f"list_sum(list_transform(list_distinct(string_split({h}, '')), "
            f"lambda c: -({share}) * log2({share}))) END)")


def brand_clean(d: str) -> str:
    x = f"split_part(split_part(regexp_replace(lower({d}), '^https?://', ''), '/', 1), ':', 1)"
    return f"(CASE WHEN starts_with({x}, 'www.') THEN substr({x}, 5) ELSE {x} END)"


def brand_tokens(d: str) -> str:
    return f"list_filter(regexp_split_to_array({brand_clean(d)}, '[.\\-]'), lambda t: t <> '')"


def tld_host(d: str) -> str:
    x = f"(CASE WHEN contains({d}, '://') THEN {netloc(d)} ELSE {d} END)"
    h = host_of(x)
    return f"lower(CASE WHEN starts_with({h}, 'www.') THEN substr({h}, 5) ELSE {h} END)"


def py_strip(s: str) -> str:
    return f"regexp_replace({s}, {q('^' + PY_SPACE_CLASS + '+|' + PY_SPACE_CLASS + '+$')}, '', 'g')"


HAS_BRACKET = r"^(?:https?://)?[^/?#]*[\[\]]"


def _ipv6_re() -> str:
    """The nine forms of an address as RFC 3986 lists them."""
    h = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    last = f"(?:{h}:{h}|{octet}(?:[.]{octet}){{3}})"
    forms = [f"(?:{h}:){{6}}{last}", f"::(?:{h}:){{5}}{last}"]
    forms += [f"(?:(?:{h}:){{0,{k}}}{h})?::(?:{h}:){{{4 - k}}}{last}" for k in range(5)]
    forms += [f"(?:(?:{h}:){{0,5}}{h})?::{h}", f"(?:(?:{h}:){{0,6}}{h})?::"]
    return "(?:" + "|".join(forms) + ")"


BRACKET_OK = (r"^(?:https?://)?(?:[^/?#\[\]]*@)?\[(?:" + _ipv6_re() + r"(?:%[^%\]/?#@]+)?|v[0-9A-Fa-f]+\.[^\]/?#@]+)\]"
              r"(?::[^/?#@]*)?(?:[/?#]|\z)")


def bad_netloc(v: str) -> str:
    """On the stripped request text (its netloc follows an optional http(s)://)."""
    return f"(regexp_matches({v}, {q(HAS_BRACKET)}) AND NOT regexp_matches({v}, {q(BRACKET_OK)}))"


def alternation(words) -> str:
    return "|".join(words)


# ------------------------------------------------------------------- CTEs

def kw_values() -> str:
    rows, i = [], 0
    for b, kws in FV.BRAND_KEYWORDS.items():
        for k in kws:
            rows.append((b, k, i))
            i += 1
    return values(rows)


CTE = {}
CTE["lures"] = f"lures(i, scheme, lure) AS ({values(LURES)})"
CTE["scan_requests"] = f"""scan_requests AS (
  SELECT e.event_id AS request_id, e.ts AS ts, e.user_id AS client_id,
         CASE WHEN l.i IS NULL THEN p.url
              ELSE l.scheme || replace(l.lure, '{{n}}', CAST(p.page_id AS VARCHAR))
                   || regexp_replace(p.url, '^https?://[^/]*', '') END AS url
  FROM events e
  CROSS JOIN (SELECT count(*) AS n FROM pages) c
  JOIN pages p ON p.page_id = e.event_id % c.n
  LEFT JOIN lures l ON l.i = p.page_id % {LURE_MODULUS})"""
CTE["hosts"] = """hosts AS (
  SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain, min(request_id) AS host_id
  FROM scan_requests GROUP BY 1)"""
CTE["dns_records"] = """dns_records AS (
  SELECT domain, 'A' AS rtype, '10.0.' || k || '.' || (host_id % 250) AS rdata
    FROM hosts, range(3) t(k) WHERE k <= host_id % 3 AND host_id % 5 <> 0
  UNION ALL SELECT domain, 'AAAA', '2001:db8::' || (host_id % 250) FROM hosts WHERE host_id % 4 = 1
  UNION ALL SELECT domain, 'MX', '10 mail.' || domain || '.' FROM hosts WHERE host_id % 2 = 0)"""
CTE["whois_records"] = """whois_records AS (
  SELECT domain,
    CASE WHEN k = 1 THEN TIMESTAMP '2024-01-20 00:00:00' ELSE TIMESTAMP '2024-01-10 00:00:00' END AS observed_at,
    TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST((host_id * 37) % 400 - 5 AS INTEGER)) + INTERVAL 7 HOUR AS creation_date,
    CASE WHEN host_id % 6 = 0 THEN NULL WHEN host_id % 6 = 1 THEN 'Registrar 1|Registrar 1b'
         ELSE 'Registrar ' || (host_id % 4) END AS registrars,
    CASE WHEN host_id % 5 = 0 THEN 'WhoisGuard Protected' WHEN host_id % 5 = 1 THEN 'REDACTED FOR PRIVACY'
         WHEN host_id % 5 = 2 THEN NULL WHEN k = 1 THEN 'Acme Ltd' ELSE 'Domains By Proxy' END AS org
  FROM hosts, range(1, 3) t(k) WHERE host_id % 7 <> 0 AND (k = 1 OR host_id % 2 = 0))"""
CTE["tls_observations"] = f"""tls_observations AS (
  SELECT domain, TIMESTAMP '2024-01-20 00:00:00' AS observed_at, status,
    CASE WHEN status = 'NO_LISTENER' THEN NULL WHEN host_id % 8 = 3 THEN 'organizationName=MyOwnCA;commonName=x'
         WHEN host_id % 3 = 0 THEN 'commonName=R3' ELSE 'organizationName=Trusty, Inc.' END AS issuer,
    CASE WHEN status = 'NO_LISTENER' THEN NULL WHEN host_id % 8 = 3 THEN 'commonName=x;organizationName=MyOwnCA'
         ELSE 'commonName=' || domain END AS subject,
    CASE WHEN status = 'NO_LISTENER' OR host_id % 16 = 7 THEN NULL
         ELSE [{', '.join(q(t) for t in NOT_AFTER_TIMES)}][host_id % 3 + 1]
              || CASE WHEN status = 'UNTRUSTED' THEN ' 2023 GMT' ELSE ' 2024 GMT' END END AS not_after
  FROM (SELECT *, CASE WHEN host_id % 4 = 0 THEN 'NO_LISTENER' WHEN host_id % 4 = 3 THEN 'UNTRUSTED'
                       ELSE 'VALID' END AS status FROM hosts) h)"""
CTE["kw"] = f"kw(brand, keyword, ord) AS ({kw_values()})"
CTE["tld_dim"] = f"tld_dim(suffix, risk) AS ({values([(s, float(r)) for s, r in FV.TLD_RISK.items()])})"
CTE["valid_requests"] = f"""valid_requests AS (
  SELECT request_id, ts, client_id,
         CASE WHEN starts_with(v, 'http://') OR starts_with(v, 'https://') THEN v ELSE 'https://' || v END AS url
  FROM (SELECT *, {py_strip('url')} AS v FROM scan_requests) s
  WHERE url IS NOT NULL AND length(v) > 0 AND length(v) <= {FV.MAX_URL_LENGTH}
    AND NOT {bad_netloc("v")})"""
CTE["req_domains"] = f"""req_domains AS (
  SELECT DISTINCT {domain_key('url')} AS domain FROM valid_requests)"""
CTE["tok"] = f"""tok AS (
  SELECT domain, {brand_tokens('domain')} AS tokens FROM req_domains)"""
CTE["tok_x"] = """tok_x AS (
  SELECT domain, CAST(generate_subscripts(tokens, 1) - 1 AS INTEGER) AS pos, unnest(tokens) AS token FROM tok)"""
CTE["kw_hits"] = """kw_hits AS (
  SELECT t.domain, k.brand, k.keyword FROM tok t JOIN kw k ON contains(array_to_string(t.tokens, ''), k.keyword))"""
CTE["typo_hits"] = f"""typo_hits AS (
  SELECT x.domain, x.pos, x.token, k.brand, k.keyword, CAST(levenshtein(x.token, k.keyword) AS INTEGER) AS distance,
         {FV.KEYWORD_HIT_WEIGHT}::DOUBLE * (1.0::DOUBLE - levenshtein(x.token, k.keyword)::DOUBLE / 3.0::DOUBLE) AS weight
  FROM tok_x x JOIN kw k ON length(x.token) >= {FV.MIN_TYPOSQUAT_TOKEN_LENGTH}
   AND abs(length(x.token) - length(k.keyword)) <= {FV.MAX_TYPOSQUAT_DISTANCE}
   AND levenshtein(x.token, k.keyword) BETWEEN 1 AND {FV.MAX_TYPOSQUAT_DISTANCE})"""
_action = "[" + ", ".join(q(w) for w in FV.ACTION_WORDS) + "]"
CTE["brand"] = f"""brand AS (
  SELECT t.domain,
    {py_round(f"least({FV.KEYWORD_HIT_WEIGHT}::DOUBLE * coalesce(a.n_kw, 0) + coalesce(a.typo_sum, 0.0::DOUBLE) + CASE WHEN list_has_any(t.tokens, {_action}) AND coalesce(a.n_kw, 0) + coalesce(a.n_typo, 0) > 0 THEN {FV.ACTION_WORD_BOOST}::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE)", 4)} AS brand_impersonation_score,
    CAST(coalesce(a.n_brands, 0) AS INTEGER) AS brand_matched_count,
    CAST(coalesce(a.n_kw, 0) AS INTEGER) AS brand_keyword_hit_count,
    CAST(coalesce(a.n_typo, 0) AS INTEGER) AS brand_typosquat_hit_count,
    CAST(list_has_any(t.tokens, {_action}) AS INTEGER) AS brand_has_action_word,
    coalesce(a.matched_brands, '') AS matched_brands,
    coalesce(a.keyword_hits, '') AS keyword_hits,
    a.closest_brand
  FROM tok t LEFT JOIN (
    SELECT domain, count(*) FILTER (WHERE is_kw) AS n_kw, count(*) FILTER (WHERE NOT is_kw) AS n_typo,
           sum(weight) AS typo_sum, count(DISTINCT brand) AS n_brands,
           array_to_string(list_sort(list_distinct(list(brand))), '|') AS matched_brands,
           coalesce(array_to_string(list_sort(list_distinct(list(keyword) FILTER (WHERE is_kw))), '|'), '') AS keyword_hits,
           split_part(min(distance || '|' || brand), '|', 2) AS closest_brand
    FROM (SELECT domain, brand, keyword, 0 AS distance, 0.0::DOUBLE AS weight, true AS is_kw FROM kw_hits
          UNION ALL SELECT domain, brand, keyword, distance, weight, false FROM typo_hits) h
    GROUP BY domain) a ON a.domain = t.domain)"""
CTE["tld"] = f"""tld AS (
  SELECT d.domain, coalesce(s2.suffix, c1) AS tld, coalesce(s2.risk, s1.risk, {FV.UNKNOWN_TLD_RISK}::DOUBLE) AS tld_risk_score,
         CAST(s2.suffix IS NOT NULL OR s1.suffix IS NOT NULL AS INTEGER) AS tld_known
  FROM (SELECT domain, array_to_string(string_split(h, '.')[-2:], '.') AS c2, string_split(h, '.')[-1] AS c1
        FROM (SELECT domain, {tld_host('domain')} AS h FROM req_domains) x) d
  LEFT JOIN tld_dim s2 ON s2.suffix = d.c2 AND contains(s2.suffix, '.')
  LEFT JOIN tld_dim s1 ON s1.suffix = d.c1 AND NOT contains(s1.suffix, '.'))"""


def idn_select(dcol: str = "domain") -> str:
    d = f"lower({py_strip(dcol)})"
    n = nclass(d, _CONFUSABLE_CLASS)
    risk = (f"CASE WHEN {n} > 0 THEN least(0.5::DOUBLE + 0.15::DOUBLE * {n}, 1.0::DOUBLE) "
            f"WHEN contains({d}, 'xn--') THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END")
    return (f"CAST({n} > 0 OR contains({d}, 'xn--') AS INTEGER) AS idn_is_homograph, "
            f"CAST({n} AS INTEGER) AS idn_confusable_count, "
            f"{py_round(risk, 4)} AS idn_risk_score, "
            f"CAST(contains({d}, 'xn--') AS INTEGER) AS idn_punycode_flag")


CTE["idn"] = f"idn AS (SELECT domain, {idn_select()} FROM req_domains)"
CTE["dns"] = """dns AS (
  SELECT lower(domain) AS domain,
    count(DISTINCT rdata) FILTER (WHERE upper(rtype) IN ('A', 'AAAA')) > 0 AS dns_resolves,
    CAST(count(DISTINCT rdata) FILTER (WHERE upper(rtype) = 'A') AS INTEGER) AS dns_a_record_count,
    count(DISTINCT rdata) FILTER (WHERE upper(rtype) = 'AAAA') > 0 AS dns_has_aaaa,
    coalesce(bool_or(upper(rtype) = 'MX'), false) AS dns_has_mx,
    array_to_string(list_concat(coalesce(list_sort(list_distinct(list(rdata) FILTER (WHERE upper(rtype) = 'A'))), []),
                                coalesce(list_sort(list_distinct(list(rdata) FILTER (WHERE upper(rtype) = 'AAAA'))), [])), ',') AS dns_resolved_ips
  FROM dns_records GROUP BY 1)"""


def _days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS INTEGER)"


CTE["whois"] = f"""whois AS (
  SELECT domain,
    creation_date IS NOT NULL OR registrar IS NOT NULL AS whois_found,
    {_days(ts(AGES_AS_OF), 'creation_date')} AS whois_domain_age_days,
    registrar AS whois_registrar,
    coalesce({_days(ts(AGES_AS_OF), 'creation_date')} < {FV.RECENTLY_REGISTERED_DAYS}, false) AS whois_recently_registered,
    regexp_matches(lower(coalesce(org, '')), {q(alternation(FV.WHOIS_PRIVACY_TERMS))}) AS whois_privacy_protected
  FROM (SELECT lower(domain) AS domain, creation_date, string_split(registrars, '|')[1] AS registrar, org,
               row_number() OVER (PARTITION BY lower(domain) ORDER BY observed_at DESC, creation_date DESC NULLS LAST,
                                  registrars DESC NULLS LAST, org DESC NULLS LAST) AS rn
        FROM whois_records WHERE observed_at <= {ts(AGES_AS_OF)}) w
  WHERE rn = 1)"""


def _attr(col: str, key: str) -> str:
    return (f"(CASE WHEN regexp_matches({col}, {q('(^|;)' + key + '=')}) "
            f"THEN regexp_extract({col}, {q('(?:^|;)' + key + '=([^;]*)')}, 1) END)")


CTE["tls"] = f"""tls AS (
  SELECT domain,
    coalesce(st = 'VALID', false) AS ssl_valid,
    coalesce(st = 'UNTRUSTED' AND coalesce(issuer, '') <> ''
             AND list_sort(string_split(issuer, ';')) = list_sort(string_split(subject, ';')), false) AS ssl_self_signed,
    CASE WHEN st IN ('VALID', 'UNTRUSTED') THEN coalesce(nullif({_attr('issuer', 'organizationName')}, ''), {_attr('issuer', 'commonName')}) END AS ssl_issuer,
    CASE WHEN st IN ('VALID', 'UNTRUSTED') THEN days END AS ssl_days_until_expiry,
    CASE WHEN st = 'VALID' THEN days < 0 WHEN st = 'UNTRUSTED' THEN coalesce(days < 0, false) END AS ssl_expired
  FROM (SELECT lower(domain) AS domain, upper(status) AS st, issuer, subject,
               {_days("try_strptime(regexp_replace(not_after, ' +', ' ', 'g'), '%b %d %H:%M:%S %Y GMT')", ts(AGES_AS_OF))} AS days,
               row_number() OVER (PARTITION BY lower(domain) ORDER BY observed_at DESC, status DESC, issuer DESC NULLS LAST,
                                  subject DESC NULLS LAST, not_after DESC NULLS LAST) AS rn
        FROM tls_observations WHERE observed_at <= {ts(AGES_AS_OF)}) t
  WHERE rn = 1)"""
CTE["enrich"] = f"""enrich AS (
  SELECT r.domain,
    coalesce(d.dns_resolves, false) AS dns_resolves,
    coalesce(d.dns_a_record_count, 0) AS dns_a_record_count,
    CAST(coalesce(d.dns_has_aaaa, false) AS INTEGER) AS dns_has_aaaa,
    CAST(coalesce(d.dns_has_mx, false) AS INTEGER) AS dns_has_mx,
    w.whois_domain_age_days,
    CAST(coalesce(w.whois_recently_registered, false) AS INTEGER) AS whois_recently_registered,
    CAST(coalesce(w.whois_privacy_protected, false) AS INTEGER) AS whois_privacy_protected,
    CAST(coalesce(w.whois_found, false) AS INTEGER) AS whois_found,
    w.whois_registrar,
    coalesce(t.ssl_valid, false) AS ssl_valid,
    CAST(coalesce(t.ssl_self_signed, false) AS INTEGER) AS ssl_self_signed,
    t.ssl_days_until_expiry, t.ssl_issuer
  FROM (SELECT domain, lower({host_of('domain')}) AS jh FROM req_domains) r
  LEFT JOIN dns d ON d.domain = r.jh
  LEFT JOIN whois w ON w.domain = r.jh
  LEFT JOIN tls t ON t.domain = r.jh)"""

LEX_COLS = ["url_length", "hyphen_count", "dot_count", "digit_count", "entropy", "subdomain_depth",
            "has_https", "is_ip_address", "has_at_symbol", "path_length", "query_param_count",
            "special_char_count"]


def lexical_select(u: str = "url") -> str:
    du = default_scheme(u)
    h = host_of(url_part(du, 2))
    path = f"regexp_replace({url_part(du, 3)}, ';[^/]*$', '')"
    qry = url_part(du, 4)
    return ", ".join([
        f"CAST(length({u}) AS INTEGER) AS url_length",
        f"CAST({nchar(h, '-')} AS INTEGER) AS hyphen_count",
        f"CAST({nchar(h, '.')} AS INTEGER) AS dot_count",
        f"CAST({nclass(h, PY_DIGIT_CLASS)} AS INTEGER) AS digit_count",
        f"{py_round(entropy(h), 4)} AS entropy",
        f"CAST(greatest(len(list_filter(string_split({h}, '.'), lambda x: x <> '')) - 2, 0) AS INTEGER) AS subdomain_depth",
        f"CAST(lower({url_part(du, 1)}) = 'https' AS INTEGER) AS has_https",
        f"CAST(regexp_matches({h}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') AS INTEGER) AS is_ip_address",
        f"CAST(contains({u}, '@') AS INTEGER) AS has_at_symbol",
        f"CAST(length({path}) AS INTEGER) AS path_length",
        f"CAST(CASE WHEN {qry} = '' THEN 0 ELSE len(string_split({qry}, '&')) END AS INTEGER) AS query_param_count",
        f"CAST({nclass(u, '[^a-zA-Z0-9.\\-/:]')} AS INTEGER) AS special_char_count",
    ])


FEATURE_COLS = [
    *LEX_COLS, "brand_impersonation_score", "brand_matched_count", "brand_keyword_hit_count",
    "brand_typosquat_hit_count", "brand_has_action_word", "tld", "tld_risk_score", "tld_known",
    "idn_is_homograph", "idn_confusable_count", "idn_risk_score", "idn_punycode_flag",
    "dns_resolves", "dns_a_record_count", "dns_has_aaaa", "dns_has_mx",
    "whois_domain_age_days", "whois_recently_registered", "whois_privacy_protected", "whois_found",
    "ssl_valid", "ssl_self_signed", "ssl_days_until_expiry",
    "visual_similarity_score", "dom_credential_form_detected", "aggregate_lexical_risk_score",
]

CTE["features"] = f"""features AS (
  SELECT v.request_id, v.ts, v.url, v.domain, {", ".join("v." + c for c in LEX_COLS)},
    b.brand_impersonation_score, b.brand_matched_count, b.brand_keyword_hit_count,
    b.brand_typosquat_hit_count, b.brand_has_action_word, b.closest_brand,
    t.tld, t.tld_risk_score, t.tld_known,
    i.idn_is_homograph, i.idn_confusable_count, i.idn_risk_score, i.idn_punycode_flag,
    e.dns_resolves, e.dns_a_record_count, e.dns_has_aaaa, e.dns_has_mx,
    e.whois_domain_age_days, e.whois_recently_registered, e.whois_privacy_protected, e.whois_found,
    e.ssl_valid, e.ssl_self_signed, e.ssl_days_until_expiry, e.whois_registrar, e.ssl_issuer,
    CAST(NULL AS DOUBLE) AS visual_similarity_score, CAST(NULL AS BOOLEAN) AS dom_credential_form_detected,
    {py_round("least(0.4::DOUBLE * b.brand_impersonation_score + 0.3::DOUBLE * t.tld_risk_score + 0.2::DOUBLE * i.idn_risk_score + 0.1::DOUBLE * least(v.entropy / 5.0::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE)", 4)} AS aggregate_lexical_risk_score
  FROM (SELECT request_id, ts, url, {domain_key('url')} AS domain, {lexical_select('url')} FROM valid_requests) v
  LEFT JOIN brand b ON b.domain = v.domain
  LEFT JOIN tld t ON t.domain = v.domain
  LEFT JOIN idn i ON i.domain = v.domain
  LEFT JOIN enrich e ON e.domain = v.domain)"""


def uuid_sql(key: str, ns: str) -> str:
    h = f"sha256({q(ns + ':')} || CAST({key} AS VARCHAR))"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
            f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12))")


def _category(d: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({d}, {q(p)}) THEN {q(c)}" for p, c in FIXTURE_CATEGORY_RULES)
    return f"(CASE {whens} ELSE 'generic' END)"


_rule = alternation(FV.RULE_SCORE_WORDS)
CTE["scans"] = f"""scans AS (
  SELECT {uuid_sql('request_id', 'scan')} AS id, domain, url, score,
    CASE WHEN score >= {FV.HIGH_RISK_THRESHOLD} THEN 'PHISHING' WHEN score >= {FV.MEDIUM_RISK_THRESHOLD} THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict,
    score / 100.0::DOUBLE AS confidence, {_category('domain')} AS category,
    request_id % 10 = 0 AS is_zero_day,
    whois_domain_age_days AS domain_age_days, whois_registrar AS registrar, ssl_issuer,
    CAST(NULL AS DOUBLE) AS visual_similarity, closest_brand,
    CAST(NULL AS VARCHAR) AS incident_id, false AS report_generated, ts AS created_at,
    CAST(NULL AS INTEGER) AS scan_duration_ms, aggregate_lexical_risk_score, brand_impersonation_score
  FROM (SELECT *, CAST(CASE WHEN regexp_matches(domain, {q(_rule)}) THEN {FV.RULE_SCORE_HIT} ELSE {FV.RULE_SCORE_MISS} END AS INTEGER) AS score
        FROM features) f)"""
CTE["feed"] = f"""feed AS (
  SELECT {uuid_sql('id', 'feed')} AS id, domain, score, verdict, category, created_at AS flagged_at, id AS scan_id
  FROM scans WHERE score >= {FV.MEDIUM_RISK_THRESHOLD})"""

ORDER = ["lures", "scan_requests", "hosts", "dns_records", "whois_records", "tls_observations", "kw",
         "tld_dim", "valid_requests", "req_domains", "tok", "tok_x", "kw_hits", "typo_hits", "brand", "tld",
         "idn", "dns", "whois", "tls", "enrich", "features", "scans", "feed"]


def with_ctes(body: str, **other: str) -> str:
    """``body`` over the views; ``other`` replaces views by name."""
    return "WITH " + ",\n".join(other.get(k, CTE[k]) for k in ORDER) + "\n" + body


SCAN_SCALAR_COLS = ["id", "domain", "url", "score", "verdict", "confidence", "category", "is_zero_day",
                    "domain_age_days", "registrar", "ssl_issuer", "visual_similarity", "closest_brand",
                    "incident_id", "report_generated", "created_at", "scan_duration_ms"]

VALIDATION_VARIANTS = {
    0: "url",
    1: "' \t' || url || '" + "　" + " '",
    2: "regexp_replace(url, '^https?://', '')",
    3: "'HTTP://' || regexp_replace(url, '^https?://', '')",
    4: "' \n '",
    5: "url || repeat('a', 500)",
    6: "regexp_replace(url, '^(https?://)', '\\1[')",
}


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    variants = " UNION ALL ".join(f"SELECT page_id, {k} AS variant, {v} AS raw FROM pages"
                                  for k, v in VALIDATION_VARIANTS.items())
    strip = py_strip("raw")
    norm = f"(CASE WHEN starts_with(v, 'http://') OR starts_with(v, 'https://') THEN v ELSE 'https://' || v END)"
    o["url_validate"] = f"""
      SELECT page_id, variant, CASE WHEN reason IS NULL THEN norm END AS url, reason AS reject_reason
      FROM (SELECT page_id, variant, {norm} AS norm,
                   CASE WHEN raw IS NULL OR length(v) = 0 THEN 'empty' WHEN length(v) > {FV.MAX_URL_LENGTH} THEN 'too_long'
                        WHEN {bad_netloc('v')} THEN 'bad_netloc' END AS reason
            FROM (SELECT page_id, variant, raw, {strip} AS v FROM ({variants}) a) b) c"""
    o["url_lexical"] = with_ctes(f"SELECT request_id, {lexical_select('url')} FROM valid_requests")
    o["url_entropy"] = with_ctes(f"""SELECT host, {py_round(entropy('host'), 4)} AS entropy
      FROM (SELECT DISTINCT {host_of(url_part(default_scheme('url'), 2))} AS host FROM valid_requests) h""")
    o["tld_risk"] = with_ctes("SELECT domain, tld, tld_risk_score, tld_known FROM tld")
    lookalike = (f"SELECT domain FROM req_domains UNION SELECT translate(domain, 'aeo', "
                 f"{q(chr(0x430) + chr(0x435) + chr(0x3BF))}) FROM req_domains")
    o["idn_homograph"] = with_ctes(f"SELECT domain, {idn_select()} FROM ({lookalike}) d")
    o["idn_confusables"] = with_ctes(f"""
      SELECT domain, pos, ch, 'U+' || upper(printf('%04x', unicode(ch))) AS codepoint, looks_like
      FROM (SELECT domain, CAST(generate_subscripts(chars, 1) AS INTEGER) AS pos, unnest(chars) AS ch
            FROM (SELECT domain, string_split(lower({py_strip('domain')}), '') AS chars FROM ({lookalike}) d
                  WHERE regexp_matches(domain, '[^\\x00-\\x7F]')) x) y
      JOIN ({values([(c, l) for c, l in FV.CONFUSABLES.items()])}) AS cf(c, looks_like) ON cf.c = y.ch""")
    o["brand_tokens"] = with_ctes(f"""SELECT domain, pos, token, list_contains({_action}, token) AS is_action_word FROM tok_x""")
    o["brand_action_domains"] = with_ctes(f"SELECT DISTINCT domain FROM tok_x WHERE list_contains({_action}, token)")
    o["brand_keyword_hits"] = with_ctes("SELECT domain, brand, keyword FROM kw_hits")
    o["brand_typosquat_hits"] = with_ctes("SELECT domain, pos, token, brand, keyword, distance, weight FROM typo_hits")
    o["brand_score"] = with_ctes("SELECT * FROM brand")
    o["brand_score_rowlocal"] = o["brand_score"]
    o["brand_score_custom"] = with_ctes("SELECT * FROM brand", kw="""kw(brand, keyword, ord) AS (
      WITH lab AS (SELECT page_id, regexp_extract(url, '^https?://([a-z]+)', 1) AS l FROM pages)
      SELECT 'B-' || substr(l, 1, 3), substr(l, 1, 6), 0 FROM lab WHERE length(l) >= 4 AND page_id % 7 = 0
      UNION ALL SELECT 'Again', substr(l, 1, 6), 0 FROM lab WHERE length(l) >= 4 AND page_id % 49 = 0
      UNION ALL SELECT 'Empty', '', 0)""")
    o["tld_risk_custom"] = with_ctes("SELECT domain, tld, tld_risk_score, tld_known FROM tld", tld_dim="""tld_dim(suffix, risk) AS (
      SELECT DISTINCT s, length(s) / 100.0::DOUBLE FROM (
        SELECT regexp_extract(regexp_extract(url, '^https?://([^/]*)', 1), '([a-z]+[.][a-z]+)$', 1) AS s FROM pages) x
      WHERE s <> '' AND s <> 'example.org' UNION ALL SELECT 'org', 0.75::DOUBLE)""")
    o["dns_rollup"] = with_ctes("SELECT * FROM dns")
    o["whois_derive"] = with_ctes("SELECT * FROM whois")
    o["tls_derive"] = with_ctes("SELECT * FROM tls")
    o["domains_without_dns"] = with_ctes(
        f"SELECT domain FROM req_domains WHERE lower({host_of('domain')}) NOT IN (SELECT lower(domain) FROM dns_records)")
    o["feature_vector"] = with_ctes(f"SELECT request_id, domain, {', '.join(FEATURE_COLS)} FROM features")
    o["feature_vector_rowlocal"] = o["feature_vector"]
    o["feature_vector_salted"] = o["feature_vector"]
    o["scan_results"] = with_ctes(f"SELECT {', '.join(SCAN_SCALAR_COLS)} FROM scans")
    o["threat_feed"] = with_ctes("SELECT * FROM feed")
    o["feed_page"] = with_ctes("SELECT * FROM feed ORDER BY flagged_at DESC, id ASC LIMIT 50 OFFSET 50")
    o["feed_page_category"] = with_ctes(
        "SELECT * FROM feed WHERE category = 'banking' ORDER BY flagged_at DESC, id ASC LIMIT 200")
    day = ts(STATS_AS_OF)
    o["daily_stats"] = with_ctes(f"""
      SELECT (SELECT count(*) FROM feed WHERE flagged_at >= {day}) AS threats_today,
             {py_round(f"coalesce((SELECT avg(confidence) FROM scans WHERE created_at >= {day}), 0.0::DOUBLE) * 100.0::DOUBLE", 1)} AS avg_confidence,
             (SELECT count(*) FROM scans WHERE is_zero_day AND created_at >= {day}) AS zero_day_count,
             CAST(0 AS BIGINT) AS cert_alerts_count""")
    o["scan_by_id"] = with_ctes(f"""SELECT {', '.join(SCAN_SCALAR_COLS)} FROM scans
      WHERE id IN (SELECT scan_id FROM feed ORDER BY flagged_at DESC, id ASC LIMIT 50)""")
    o["incident_report"] = with_ctes(f"""SELECT {q(FV.INCIDENT_ID_PREFIX)} || upper(substr(id, 1, 4)) AS incident_id,
      domain, score, verdict, {q(FV.REPORT_STATUS)} AS status FROM scans""")
    o["sink_roundtrip"] = with_ctes(f"""SELECT {', '.join(SCAN_SCALAR_COLS)}, aggregate_lexical_risk_score,
      brand_impersonation_score, CAST(created_at AS DATE) AS created_date FROM scans""")
    o["stream_scan"] = o["scan_results"]
    o["stream_feed"] = o["threat_feed"]
    o["stream_scan_rowlocal"] = o["scan_results"]
    by_domain = f"(SELECT request_id, ts, {domain_key('url')} AS domain FROM valid_requests)"
    o["stream_daily_stats"] = with_ctes("""
      SELECT CAST(date_trunc('day', created_at) AS DATE) AS day,
             count(*) FILTER (WHERE score >= 40) AS threats,
             CAST(printf('%.1f', CAST(sum(CAST(confidence AS DECIMAL(30, 15))) AS DOUBLE) / count(*) * 100.0::DOUBLE) AS DOUBLE) AS avg_confidence,
             count(*) FILTER (WHERE is_zero_day) AS zero_day_count
      FROM scans GROUP BY 1""")
    o["stream_dedup_domain"] = with_ctes("""
      SELECT domain, hour, request_id, ts FROM (
        SELECT domain, date_trunc('hour', ts) AS hour, request_id, ts,
               row_number() OVER (PARTITION BY domain, date_trunc('hour', ts) ORDER BY ts, request_id) AS k FROM req_by_domain) x
      WHERE k = 1""".replace("req_by_domain", by_domain))
    o["stream_quarantine"] = """SELECT CASE WHEN event_id % 100 = 0 THEN 'empty' ELSE 'accepted' END AS outcome, count(*) AS n
      FROM events GROUP BY 1"""
    o["sink_two_runs"] = o["scan_results"]
    o["sink_rescore"] = with_ctes("SELECT * FROM feed WHERE flagged_at < TIMESTAMP '2024-01-15 00:00:00'")
    o["scan_results_custom_scorer"] = with_ctes("""
      SELECT s.id, s.domain, s.score, CASE WHEN s.score >= 90 THEN 'PHISHING' WHEN s.score >= 50 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict,
             'model' AS category, length(s.url) > 45 AS is_zero_day, 0.25::DOUBLE AS visual_similarity, 'scored' AS registrar,
             'url_length' AS shap_feature, length(s.url)::DOUBLE AS shap_value, 38 AS n_features FROM scans s""")
    o["zero_day_blacklist"] = with_ctes("""
      SELECT request_id, domain, domain NOT IN (SELECT domain FROM req_by_domain k WHERE request_id % 97 = 0) AS is_zero_day
      FROM req_by_domain r""".replace("req_by_domain", by_domain))
    o["category_by_brand"] = with_ctes("""
      SELECT id, s.closest_brand, coalesce(c.category, 'generic') AS category FROM scans s
      LEFT JOIN (SELECT closest_brand, 'brand-' || lower(closest_brand) AS category FROM scans WHERE closest_brand IS NOT NULL
                 GROUP BY closest_brand HAVING count(*) % 2 = 0) c ON s.closest_brand = c.closest_brand""")
    o["feed_page_after"] = o["feed_page"]
    o["scan_by_one_id"] = with_ctes(f"""SELECT {', '.join(SCAN_SCALAR_COLS)} FROM scans
      WHERE id = (SELECT scan_id FROM feed ORDER BY flagged_at DESC, id ASC LIMIT 1)""")
    o["scans_by_domain"] = with_ctes(f"SELECT {', '.join(SCAN_SCALAR_COLS)} FROM scans WHERE domain = 'amazon.in'")
    o |= _over_time(by_domain)
    o |= _screening(by_domain)
    o["brand_score_file"] = o["brand_score_custom"]
    o["tld_risk_file"] = o["tld_risk_custom"]
    return o


def _over_time(by_domain: str) -> dict[str, str]:
    """Reuse window, point-in-time enrichment, closed days, committed runs, JSON requests."""
    o: dict[str, str] = {}
    o["stream_reuse_window"] = with_ctes(f"""SELECT * FROM (
      WITH RECURSIVE r AS (SELECT request_id, ts, domain FROM {by_domain} x),
      u AS (SELECT domain, ts, min(request_id) AS id FROM r GROUP BY domain, ts),
      n AS (SELECT *, min(ts) OVER (PARTITION BY domain ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS FOLLOWING AND UNBOUNDED FOLLOWING) AS nts FROM u),
      chain AS (SELECT n.domain, n.ts, n.id, n.nts FROM n JOIN (SELECT domain, min(ts) AS t FROM u GROUP BY domain) f ON f.domain = n.domain AND f.t = n.ts
                UNION ALL SELECT n.domain, n.ts, n.id, n.nts FROM chain c JOIN n ON n.domain = c.domain AND n.ts = c.nts)
      SELECT r.request_id, r.domain, r.ts, c.id AS scan_id, c.ts AS scan_ts, c.id = r.request_id AS fresh
      FROM r ASOF JOIN (SELECT * FROM chain) c ON r.domain = c.domain AND r.ts >= c.ts) z""")
    o["stream_closed_days"] = with_ctes("""
      SELECT CAST(created_at AS DATE) AS day, count(*) FILTER (WHERE score >= 40) AS threats,
             CAST(printf('%.1f', CAST(sum(CAST(confidence AS DECIMAL(30, 15))) AS DOUBLE) / count(*) * 100.0::DOUBLE) AS DOUBLE) AS avg_confidence,
             count(*) FILTER (WHERE is_zero_day) AS zero_day_count, count(*) AS scans,
             CASE WHEN CAST(created_at AS DATE) < DATE '2024-01-08' THEN count(*) ELSE 0 END AS late
      FROM scans GROUP BY 1""")
    observed = "TIMESTAMP '2024-01-02 00:00:00' + to_days(CAST({step} * k AS INTEGER)) + to_hours(CAST(host_id % 24 AS INTEGER))"
    days = "CAST(floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0) AS INTEGER)"
    age, left_ = days.format(a="r.ts", b="w.created"), days.format(a="t.not_after", b="r.ts")
    o["enrich_point_in_time"] = with_ctes(f"""SELECT * FROM (
      WITH r AS (SELECT request_id, ts, domain, lower({host_of('domain')}) AS jh FROM {by_domain} x),
      d AS (SELECT lower(domain) AS domain, {observed.format(step=7)} AS at, (host_id + k) % 4 <> 0 AS some, host_id + k AS g FROM hosts, range(4) t(k)),
      w AS (SELECT lower(domain) AS domain, {observed.format(step=10)} AS at, TIMESTAMP '2024-01-01 00:00:00' - to_days(CAST((host_id * 37) % 400 - 5 AS INTEGER)) AS created,
                   'R' || (host_id % 4 + k) AS registrar, host_id % 5 = k AS private FROM hosts, range(2) t(k) WHERE host_id % 7 <> 0),
      t AS (SELECT lower(domain) AS domain, {observed.format(step=9)} AS at, CASE (host_id + k) % 4 WHEN 0 THEN 'NONE' WHEN 3 THEN 'UNTRUSTED' ELSE 'VALID' END AS st,
                   'CA ' || k AS issuer, host_id % 3 = 0 AS same, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(4 + host_id % 20 AS INTEGER)) AS not_after
            FROM hosts, range(3) t(k))
      SELECT r.request_id, r.domain, coalesce(d.some, false) AS dns_resolves, CAST(coalesce(CASE WHEN d.some THEN d.g % 3 + 1 END, 0) AS INTEGER) AS dns_a_record_count,
             CAST(coalesce(d.some AND d.g % 3 = 1, false) AS INTEGER) AS dns_has_aaaa, CAST(coalesce(d.some AND d.g % 2 = 0, false) AS INTEGER) AS dns_has_mx,
             CAST(w.domain IS NOT NULL AS INTEGER) AS whois_found, {age} AS whois_domain_age_days, w.registrar AS whois_registrar,
             CAST(coalesce({age} < {FV.RECENTLY_REGISTERED_DAYS}, false) AS INTEGER) AS whois_recently_registered,
             CAST(coalesce(w.private, false) AS INTEGER) AS whois_privacy_protected,
             coalesce(t.st = 'VALID', false) AS ssl_valid, CAST(coalesce(t.st = 'UNTRUSTED' AND t.same, false) AS INTEGER) AS ssl_self_signed,
             CASE WHEN t.st <> 'NONE' THEN t.issuer END AS ssl_issuer, CASE WHEN t.st <> 'NONE' THEN {left_} END AS ssl_days_until_expiry,
             CASE WHEN t.st <> 'NONE' THEN {left_} < 0 END AS ssl_expired
      FROM r ASOF LEFT JOIN d ON r.jh = d.domain AND r.ts >= d.at ASOF LEFT JOIN w ON r.jh = w.domain AND r.ts >= w.at
             ASOF LEFT JOIN t ON r.jh = t.domain AND r.ts >= t.at) z""")

    def stored(runs: int, again: int) -> str:
        score = f"CASE WHEN day(created_at) % {runs} = {again} THEN 10 ELSE score END"
        return with_ctes(f"""SELECT id, domain, CAST({score} AS INTEGER) AS score, verdict, 'run-' || (day(created_at) % {runs}) AS run_id, created_at,
                                    {score} >= 40 AS in_feed FROM scans""")

    o["store_commit"], o["store_compacted"] = stored(3, 1), stored(5, 2)
    o["json_requests"] = with_ctes("""
      SELECT CASE WHEN request_id % 20 = 0 OR request_id % 31 = 0 THEN 'malformed' WHEN request_id % 37 = 0 THEN 'empty' ELSE 'accepted' END AS outcome,
             count(*) AS n, CAST(sum(CASE WHEN request_id % 20 <> 0 AND request_id % 31 <> 0 THEN request_id END) AS BIGINT) AS ids
      FROM scan_requests GROUP BY 1""")
    o["stream_json_requests"] = with_ctes("""
      SELECT CASE WHEN request_id % 20 = 0 THEN 'malformed' ELSE 'accepted' END AS outcome, count(*) AS n,
             count(*) FILTER (WHERE request_id % 20 = 0) AS with_text FROM scan_requests GROUP BY 1""")
    return o


def _screening(by_domain: str) -> dict[str, str]:
    """Listed parent domains, bracketed hosts, a fitted scorer's sums."""
    o: dict[str, str] = {}
    host = f"lower({host_of('domain')})"
    o["zero_day_parents"] = with_ctes(f"""SELECT * FROM (
      WITH r AS (SELECT request_id, domain, {host} AS host FROM {by_domain} x),
      cut AS (SELECT host, substr(host, instr(host, '.') + 1) AS up FROM r WHERE request_id % 97 = 0),
      listed AS (SELECT DISTINCT CASE WHEN contains(up, '.') THEN up ELSE host END AS e FROM cut),
      hosts_known AS (SELECT DISTINCT host FROM (SELECT DISTINCT host FROM r) h JOIN listed
                      ON host = e OR (ends_with(host, '.' || e) AND NOT regexp_full_match(host, '[0-9.]+')))
      SELECT request_id, domain, host NOT IN (SELECT host FROM hosts_known) AS is_zero_day FROM r) z""")
    g = [f"lower(to_hex(page_id * {k} % 70000))" for k in (1, 7, 31, 127, 509, 2039, 8191, 32749)]
    run = lambda k: " || ':' || ".join(g[:k])
    raw = [f"'[' || {run(8)} || ']/x'", f"'http://u@[' || {g[1]} || '::' || {g[3]} || ']:80/'",
           "'[::ffff:' || page_id % 300 || '.' || page_id % 7 || '.0.' || page_id % 256 || ']'", f"'[' || {run(7)} || ']'",
           f"'https://[' || {g[1]} || '::' || {g[2]} || '::' || {g[3]} || ']'", f"'[fe80::' || {g[1]} || '%' || repeat('z', page_id % 3) || ']'",
           f"'[v' || {g[0]} || '.' || repeat('x', page_id % 2) || ']:1?q'", f"'a[::' || {g[1]} || ']'", f"'[::' || {g[1]} || ']x'",
           f"'[' || {g[0]} || '::' || {run(6)} || ']'", f"'[' || {run(4)} || '::' || {run(4)} || ']'", f"'[' || {run(7)} || '::]#f'",
           f"'[' || {run(6)} || ':10.0.' || page_id % 260 || '.1]'", f"'u[1]@[::' || {g[2]} || ']'", f"'[' || {run(3)} || ':]'"]
    rows = " UNION ALL ".join(f"SELECT page_id, {k} AS variant, {v} AS v FROM pages" for k, v in enumerate(raw))
    o["url_validate_brackets"] = f"""
      SELECT page_id, variant, CASE WHEN NOT bad THEN CASE WHEN regexp_matches(v, '^https?://') THEN v ELSE 'https://' || v END END AS url,
             CASE WHEN bad THEN 'bad_netloc' END AS reject_reason
      FROM (SELECT *, {bad_netloc('v')} AS bad FROM ({rows}) a) b"""
    o["scan_results_fitted"] = with_ctes("""
      SELECT id, domain, 36 AS n_shap, length(url)::DOUBLE AS first_value, true AS adds_up, true AS scored, true AS judged FROM scans""")
    return o
