"""Readers and sinks on small files."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions import text as T_
from scholia.plans import registry
from scholia.sources import adapters as A
from scholia.sources import readers as R

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "é"}\n\nnot json\n{"a": 2}\n')
    assert sorted(R.read_jsonl(spark, str(tmp_path / "x.jsonl"), SCHEMA).collect()) == [(1, "é"), (2, None)]
    assert R.read_jsonl(spark, str(tmp_path / "x.jsonl"), SCHEMA).count() == 2
    assert R.read_jsonl(spark, str(tmp_path / "none.jsonl"), SCHEMA).count() == 0
    R.write_jsonl(spark.createDataFrame([(3, None)], SCHEMA), str(tmp_path / "out"))
    assert R.read_jsonl(spark, str(tmp_path / "out"), SCHEMA).collect() == [(3, None)]


@pytest.mark.parametrize(("text", "n"), [('[{"a": 1}, {"a": 2}]', 2), ('{"total": 2, "data": [{"a": 1}, {"a": 2}]}', 2), ('{"a": 1, "b": "x"}', 1), ('{"a": 1}\n{"a": 2}\n\n{"a": 3}', 3)])
def test_json_any(spark, tmp_path, text, n):
    (tmp_path / "x.json").write_text(text)
    rows = R.read_json_any(spark, str(tmp_path / "x.json"), SCHEMA).collect()
    assert [r.a for r in rows] == list(range(1, n + 1))


def test_csv_encodings(spark, tmp_path):
    for name, encoding in (("u", "utf-8"), ("g", "gb18030")):
        (tmp_path / name).write_bytes('题目,text\n"多\n行",b\n'.encode(encoding))
        df = R.read_csv(spark, str(tmp_path / name))
        assert df.columns == ["题目", "text"] and df.first()[0] == "多\n行"


def test_articles(spark, tmp_path):
    xml = "<Set><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract></Article></MedlineCitation><MedlineCitation><PMID>2</PMID><Article><ArticleTitle>U</ArticleTitle></Article></MedlineCitation></Set>"
    with gzip.open(tmp_path / "x.xml.gz", "wt") as file:
        file.write(xml)
    assert [tuple(r) for r in R.read_articles(spark, str(tmp_path / "x.xml.gz")).collect()] == [("1", "T", "a b")]


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("d/b.PNG", "d/a.jpg", "d/c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in R.list_files(spark, str(tmp_path)).collect()] == ["a.jpg", "b.PNG"]


def test_daily_log(spark, tmp_path):
    for _ in range(2):
        R.append_daily(spark.createDataFrame([(1, "2024-01-01")], "k int, day string"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        R.load(spark, "xls", "x")


def test_csv_of_no_encoding(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes(b"a,b\n\xff\xff,\x81\n")
    assert R.read_csv(spark, str(tmp_path / "b.csv")).count() == 0
    (tmp_path / "u.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,2\n")
    assert R.read_csv(spark, str(tmp_path / "u.csv")).columns == ["a", "b"]


def test_image_extensions(spark, tmp_path):
    for name in ("a.tif", "b.TIFF", "c.txt", "d.jpg"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in R.list_files(spark, str(tmp_path)).collect()] == ["a.tif", "b.TIFF", "d.jpg"]


def test_records(spark):
    rows = spark.createDataFrame([("q", "A. x\nB. y", "ba", ""), (" ", "A. x", "A", "")], "Question string, Options string, Answer string, Explanation string")
    (r,) = A.exam_records(rows, "exam", {}).collect()
    assert (r.answer_letter, r.answer, r.gt_label, r.options, r.meta) == ("AB", "x; y", "x; y", {"A": "x", "B": "y"}, {})
    rows = spark.createDataFrame([("q", ["x", "y"], "y"), ("r", ["x"], "z")], "question string, options array<string>, answer string")
    found = A.generic_records(rows, {}, T_.listed_options(F.col("options"))).orderBy("stem").collect()
    assert [(r.answer_letter, r.answer) for r in found] == [("B", "y"), ("", "z")]
    rows = spark.createDataFrame([("i1", "3", "1"), ("i2", "", "0"), ("i3", "9", None)], "`Image Name` string, `Retinopathy grade` string, `Risk of macular edema` string")
    found = A.graded_images(rows, {}, "/img/").orderBy("image").collect()
    assert [r.image for r in found] == ["/img/i1.jpg", "/img/i3.jpg"] and found[0].gt_label.endswith("(Severe NPDR)") and found[1].gt_label == A.OTHER_GRADE + "9"


@pytest.mark.parametrize("name", ["src_jsonl", "src_json_shapes", "src_exam_csv", "src_articles", "src_daily"])
def test_formats_of_empty_tables(spark, tmp_path, name):
    for table in ("documents", "customer", "part", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_options_are_parsed_once(spark):
    """A plan names each of the four extractions of a block once, whatever is made of the options."""
    rows = spark.createDataFrame([("q", "A. x\nB. y", "B", "e")], "Question string, Options string, Answer string, Explanation string")
    block = rows.select(T_.options_block(T_.parsed_options(T_.options_block(T_.parsed_options(F.col("Options"))))).alias("b"))
    exam = A.exam_records(rows, "exam", {})
    named = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert named(block) == 8 and named(exam.select("options", "answer", "gt_label", "answer_letter")) <= 5
    assert block.head().b == "A. x\nB. y" and exam.head().answer == "y"
