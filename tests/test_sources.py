"""Comment dumps in splits, and JSON models."""

import json
import random
from xml.sax.saxutils import quoteattr

import pytest
from pyspark.sql import functions as F

from glyphshift.sources import corpus

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def split(spark):
    """Sets the size of a split, and puts it back."""
    before = {k: spark.conf.get(k) for k in (SPLIT, "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}

    def to(size):
        spark.conf.set(SPLIT, size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)

    yield to
    spark.conf.unset("spark.sql.files.minPartitionNum")
    for k, v in before.items():
        spark.conf.set(k, v)


DUMP = """<?xml version="1.0" encoding="utf-8"?>
<comments>
  <row Id="1" PostId="3" Text="plain &lt;b&gt; &amp; more" Score="0" />
  <row
     Text='over
lines, with > and "quotes"'
     Id='2'/>
  <row Id="3" Score="1" />
  <row Text="no id" /><row Id="4" Text="beside the last"></row>
  <rows Id="5" Text="another element" />
  <row Id="6" Text="&#1513;&#x5DC;&#xa;second &quot;line&quot; &lt;row Id=&quot;7&quot;" CreationDate="2008" />
  <row Id="-8" Text="" /> <row />
</comments>
"""
ROWS = {(1, "plain <b> & more"), (2, 'over lines, with > and "quotes"'), (4, "beside the last"), (6, 'של\nsecond "line" <row Id="7"'), (-8, "")}


@pytest.mark.parametrize("size", ["7b", "16b", "31b", "100b", "128m"])
def test_dump_elements_over_lines_and_split_borders(spark, split, tmp_path, size):
    (tmp_path / "dump.xml").write_text(DUMP, encoding="utf-8")
    split(size)
    got = corpus.read_comment_dump(spark, str(tmp_path / "dump.xml"))
    assert sorted((r.id, r.text) for r in got.collect()) == sorted(ROWS)
    assert size == "128m" or got.rdd.getNumPartitions() >= 5


def test_a_large_dump_is_read_in_many_splits(spark, split, tmp_path):
    rng, want = random.Random(3), {}
    with open(tmp_path / "dump.xml", "w", encoding="utf-8") as file:
        file.write('<?xml version="1.0"?>\n<comments>\n')
        for i in range(60_000):
            want[i] = " ".join(rng.choices(["word", "<b>", "&amp;", "שלום", "a\nb", 'q"q'], k=rng.randint(1, 40)))
            file.write(f"  <row Id={quoteattr(str(i))} Text={quoteattr(want[i], {chr(10): '&#10;'})} />\n")
        file.write("</comments>\n")
    assert (tmp_path / "dump.xml").stat().st_size > 7_000_000
    split("500k")
    got = corpus.read_comment_dump(spark, str(tmp_path / "dump.xml"))
    assert got.rdd.getNumPartitions() > 10
    rows = got.collect()
    assert len(rows) == len(want) and {r.id: r.text for r in rows} == want


GRAMS = [(4, "abcd", 3), (4, 'a"b\\', 1), (4, ", \"x", 2), (4, "שלום", 5), (3, '": ', 9), (3, "a,b", 4), (2, "\\n", 7), (2, " a", 2**40)]


def test_model_files_are_what_json_reads(spark, tmp_path):
    frame = spark.createDataFrame(GRAMS, "n int, gram string, cnt long").repartition(3)
    for name, part in (("all", GRAMS), ("some", [g for g in GRAMS if g[0] != 3]), ("none", [])):
        path = tmp_path / f"{name}.json"
        corpus.write_json_model(frame.where(F.col("n").isin([n for n, _, _ in part] or [0])), 31, str(path))
        whole = json.loads(path.read_text(encoding="utf-8"))
        assert list(whole) == ["quadgram_counts", "trigram_counts", "bigram_counts", "vocab_size"] and whole.pop("vocab_size") == 31
        assert {(len(g), g, c) for section in whole.values() for g, c in section.items()} == set(part)
        assert {(r.n, r.gram, r.cnt) for r in corpus.read_json_models(spark, {"m": str(path)}).collect()} == set(part)
        assert corpus.json_vocabulary(spark, str(path)) == 31


@pytest.mark.parametrize("form, separator", [({"indent": 2, "ensure_ascii": False}, "\n"), ({"indent": 2}, "\n"), ({}, ', "'), ({"ensure_ascii": False}, ', "')])
@pytest.mark.parametrize("size", ["9b", "128m"])
def test_files_of_other_writers(spark, split, tmp_path, form, separator, size):
    whole = {name: {g: c for n, g, c in GRAMS if n == k} for k, name in corpus.SECTIONS.items()} | {"vocab_size": 40}
    (tmp_path / "m.json").write_text(json.dumps(whole, **form), encoding="utf-8")
    split(size)
    got = corpus.read_json_models(spark, {"m": str(tmp_path / "m.json")}, separator).collect()
    assert sorted((r.n, r.gram, r.cnt) for r in got) == sorted(GRAMS) and corpus.json_vocabulary(spark, str(tmp_path / "m.json"), separator) == 40
