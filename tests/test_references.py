"""Character references against the standard library's own pass."""

import html
import random

from pyspark.sql import functions as F

from glyphshift.functions import text as T


def test_references_like_the_standard_library(spark):
    rng = random.Random(4)
    bits = ["&", "&amp;", "&amp", "&lt;b&gt;", "&#39;", "&#x27;", "&#X1F600;", "&#8217", "&#0;", "&#150;", "&#xD800;", "&#1114112;", "&#99999999999;", "&#x7f;", "&#xfffe;", "&#13;", "&nbsp;", "&notit;", "&copyright", "&hellip;", "&am", "&unknown;", "&fjlig;", "&acE;", "x;", " ", "é", "#", "1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(800)]
    got = {r.t: r.u for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.unescape_entities("t").alias("u")).collect()}
    assert {t: u for t, u in got.items() if u != html.unescape(t)} == {}
    assert spark.range(1).select(T.unescape_entities(F.lit(None).cast("string")).alias("u")).first().u is None
