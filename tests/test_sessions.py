"""The detection stream takes every audited document as a session."""

import __spark_entry__ as entry
from glyphshift.operators import ngrams
from glyphshift.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def test_every_audited_document_is_a_session(spark):
    audited = X.audit_lines(X.lines(spark, SF))
    want = {r.doc_id for r in audited.where("lang = 'en'").select("doc_id").distinct().collect()}
    got = entry.queries()["g5_detect_stream"](spark, SF).cache()
    assert want and want <= {r.session for r in got.select("session").distinct().collect()}
    assert got.count() == ngrams.words(audited).count()
