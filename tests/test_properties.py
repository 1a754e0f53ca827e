"""Properties over the whole sf0.001 tables: one row per valid request, scores in range."""
from lurescope.plans import catalog
from lurescope.operators import scoring
from lurescope.sources import fixtures as fx
from conftest import SF_SMALL


def test_one_scan_per_valid_request(spark):
    req = fx.scan_requests(spark, SF_SMALL)
    v = scoring.validate(req)
    scans = catalog.fixture_scans(spark, SF_SMALL)
    assert scans.count() == scoring.accepted(v).count()
    assert scoring.accepted(v).count() + scoring.rejected(v).count() == req.count()
    assert scans.select("id").distinct().count() == scans.count()


def test_scores_in_range(spark):
    fv = catalog.q_feature_vector(spark, SF_SMALL)
    bad = fv.filter("aggregate_lexical_risk_score < 0 or aggregate_lexical_risk_score > 1 "
                    "or brand_impersonation_score < 0 or brand_impersonation_score > 1 "
                    "or idn_risk_score < 0 or idn_risk_score > 1 or tld_risk_score < 0 or tld_risk_score > 1")
    assert bad.count() == 0


def test_batch_and_rowlocal_forms_agree(spark):
    a = catalog.q_feature_vector(spark, SF_SMALL)
    b = catalog.q_feature_vector_rowlocal(spark, SF_SMALL)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_domain_salting_keeps_results(spark):
    """With a tiny hot threshold the fixture's repeated lure domains are salted;
    the result must be identical to the unsalted join."""
    from lurescope.operators import features
    dns, who, tls_obs = catalog._records(spark, SF_SMALL)
    req = catalog.valid_requests(spark, SF_SMALL)
    a = features.feature_vector(req, dns, who, tls_obs, fx.AGES_AS_OF)
    b = features.feature_vector(req, dns, who, tls_obs, fx.AGES_AS_OF, hot_domain_rows=5, salt_buckets=7)
    assert a.count() == b.count() == req.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
