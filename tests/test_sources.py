import gzip
import json

import pytest
from pyspark.sql import functions as F

from glossweave.sources import catalog, html, lines, readers


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_marker_records(spark, tmp_path):
    text = ("\\lx water\n\\ph [wɔtər]\n\\de a liquid\n\\de a clear liquid\n\\ps noun\n\\lg en\n"
            "\\lx fire\n\n\\et old word\n\\xx ignored\n")
    got = readers.starling(spark, write(tmp_path / "a.txt", text))
    assert sorted(rows(got, "headword", "ipa", "definition", "etymology", "pos_tag", "language")) == [
        ("fire", None, None, "old word", None, None), ("water", "wɔtər", "a clear liquid", None, "noun", "en")]
    header = readers.starling(spark, write(tmp_path / "b.txt", "\\_sh v3.0\n\\lx one\n\\lx two\n"))
    assert sorted(rows(header, "headword")) == [("one",), ("two",)]


def test_marker_blocks(spark, tmp_path):
    text = "\\lx water\n\\ph [wɔtər]\n\\de a liquid\n\n\n\\lx fire\n\\ph plain\n\\ps noun\n"
    got = readers.starling_blocks(spark, write(tmp_path / "a.txt", text))
    assert sorted(rows(got, "headword", "ipa", "definition", "pos_tag")) == [
        ("fire", None, None, "noun"), ("water", "wɔtər", "a liquid", None)]


def test_swadesh(spark, tmp_path):
    path = write(tmp_path / "s.csv", "concept,en,de\nI,I,ich\nyou, you ,-\nwe,,wir\n")
    assert sorted(rows(readers.swadesh(spark, path), "headword", "language", "concept")) == [
        ("I", "en", "I"), ("ich", "de", "I"), ("wir", "de", "we"), ("you", "en", "you")]


def test_cldf(spark, tmp_path):
    write(tmp_path / "forms.csv", 'ID,Form,Language_ID,Parameter_ID,Segments,Source,Comment\n1,mano,es,hand,m a n o,x,"a, ""b"""\n')
    write(tmp_path / "cognates.csv", "Form_ID,Cognateset_ID,Alignment,Doubt\n1,c1,m a n o,false\n")
    got = readers.cldf(spark, str(tmp_path))
    form = got.filter("type is null").first()
    assert (form.headword, form.segments, form.comment) == ("mano", ["m", "a", "n", "o"], 'a, "b"')
    assert got.filter("type = 'cognate'").first().cognateset_id == "c1"


def test_json_dictionary_both_shapes(spark, tmp_path):
    item = {"headword": "a", "language": "en"}
    for i, body in enumerate(([item], {"entries": [item, item]}), 1):
        path = write(tmp_path / f"{i}.json", json.dumps(body))
        assert rows(readers.json_entries(spark, path), "headword", "language") == [("a", "en")] * i


LINES = [
    {"word": "water", "lang": "English", "lang_code": "en", "pos": "noun", "etymology_text": "old",
     "sounds": [{"audio": "x"}, {"ipa": "wɔ"}, {"ipa": "wa"}],
     "senses": [{"glosses": ["a liquid", "rain"]}, {"raw_glosses": ["raw only"]}, {"glosses": ["sea"]}]},
    {"word": "feu", "lang": "French", "senses": []},
    {"word": "", "lang_code": "xx"},
]


@pytest.fixture
def dump(tmp_path):
    path = tmp_path / "d.jsonl.gz"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(map(json.dumps, LINES)) + "\n\n{broken\n")
    return str(path)


def test_dump_flattened_three_ways(spark, dump):
    got = readers.reader("jsonl")(spark, dump)
    assert rows(got, "headword", "language", "ipa", "definition", "etymology", "pos_tag") == [
        ("water", "en", "wɔ", "a liquid | rain | sea", "old", "noun"), ("feu", "French", None, "", "", "")]
    raw = readers.flatten_with_raw(readers.dump_lines(spark, dump))
    assert rows(raw, "headword", "ipa", "definition")[0] == ("water", None, "a liquid, rain, raw only, sea")
    stored = spark.createDataFrame([(json.dumps(x),) for x in LINES], "raw_data string")
    first = readers.flatten_first_sense(stored)
    assert rows(first, "headword", "language", "definition", "ipa") == [("water", "en", "a liquid", "")]
    long = dict(LINES[0], word="w" * 300, lang_code="engl")
    cut = readers.flatten_first_sense(spark.createDataFrame([(json.dumps(long),)], "raw_data string"), bounded=True).first()
    assert len(cut.headword) == 255 and cut.language == "eng"


def test_json_lines_modes(spark, tmp_path):
    path = write(tmp_path / "l.jsonl", '{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert sorted(rows(readers.json_lines(spark, path, "a int"), "a")) == [(1,), (2,)]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.json_lines(spark, path, "a int", skip_errors=False).collect()


XML = """<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><body>
<entry n="1"><form><orth>λόγος</orth></form><sense><def>word</def><sense><def>speech &amp; reason</def></sense></sense>
<etym>from <lang>grc</lang> root</etym></entry>
<entry><form><orth></orth></form></entry></body></TEI>"""


def test_lexicon_xml(spark, tmp_path):
    got = readers.lexicon_xml(spark, write(tmp_path / "x.xml", XML), "perseus-greek")
    # A definition below two nested senses is reached from both.
    assert rows(got, "headword", "language", "definition", "etymology") == [
        ("λόγος", "grc", "word | speech & reason | speech & reason", "from grc root")]


def test_payloads(spark):
    df = spark.createDataFrame([(1, '{"word": "a"}'), (2, '[{"word": "b"}, {"word": "c"}]')], "n int, body string")
    got = readers.payload_entries(df, "body", "struct<word:string>", lambda d: d.withColumn("word", F.upper("word")))
    assert sorted(rows(got, "n", "word")) == [(1, "A"), (2, "B"), (2, "C")]


def test_raw_rows_have_stable_checksums(spark):
    df = spark.createDataFrame([("a", "en")], "headword string, language string")
    same = df.select("language", "headword")
    a, b = readers.as_raw(df, "s").first(), readers.as_raw(same, "s").first()
    assert a.checksum == b.checksum and json.loads(a.raw_data) == {"headword": "a", "language": "en"}


def test_unknown_format():
    with pytest.raises(ValueError, match="Unknown format: pdf"):
        readers.reader("pdf")


PAGE = """<html><body><div class="entry big" id="e1"><h2>Wasser</h2><p class=def>a <b>liquid</b>
thing<p class="etym">old &amp; german</div><div class="entry"><h2></h2></div><script>var x="<div class='entry'>"</script>
<div class="other"><h2>No</h2></div><div class="entry"><section><h2>Feuer</h2></section></div></body></html>"""


def test_html_entries(spark):
    pages = spark.createDataFrame([("u1", PAGE), ("u2", "<p>nothing"), ("u3", None)], "url string, html string")
    rule = html.Selectors("div.entry", "h2", "de", definition=".def", etymology="body p.etym", ipa="#none")
    got = html.extract_entries(pages, rule)
    assert rows(got, "headword", "definition", "etymology", "ipa", "source_url", "language") == [
        ("Wasser", "aliquidthing", "old & german", "", "u1", "de"), ("Feuer", "", "", "", "u1", "de")]


def test_line_entries(spark):
    text = [(1, 1, "preface"), (1, 2, "WATER n."), (1, 3, "def: liquid"), (2, 1, "def: clear liquid"), (2, 2, "FIRE v."), (2, 3, "from: old")]
    df = spark.createDataFrame([("d", p, n, t) for p, n, t in text], "doc string, page int, line_no int, line string")
    rule = lines.LineRule(r"[A-Z]{3,}", r"^([A-Z]+)", "en", r"def: (.*)", r"from: (.*)")
    for chunk in (1, 2, 1000):
        got = lines.line_entries(df, rule, chunk)
        assert sorted(rows(got, "headword", "page", "line_no", "definition", "etymology")) == [
            ("FIRE", 2, 2, None, "old"), ("WATER", 1, 2, "clear liquid", None)]


TOML = """
[[source]]
id = "b"
name = "B"
format = "cldf"
quality = "peer_reviewed"
priority = 2
status = "ready"
entries_approx = 10
[[source]]
id = "a"
name = "A"
priority = 1
status = "deferred"
languages = ["en"]
"""


def test_catalog(spark):
    found = catalog.load_catalog(spark, TOML)
    assert [r.id for r in found.collect()] == ["a", "b"] and found.first().languages == ["en"]
    assert [r.id for r in catalog.select_sources(found, max_priority=2).collect()] == ["b"]
    assert catalog.select_sources(found, ids=["a"]).count() == 0
    assert {r.priority: r.entries_approx for r in catalog.by_priority(found).collect()} == {1: None, 2: 10}


def test_marker_files_with_a_preamble_and_indented_markers(spark, tmp_path):
    text = "Dictionary export 2020\n\\lx one\n\\de first\n  \\lx two\n\\de second\n"
    got = readers.starling(spark, write(tmp_path / "c.txt", text))
    assert sorted((r["headword"], r["definition"]) for r in got.collect()) == [("one", "first"), ("two", "second")]


def test_marker_files_open_records_at_line_starts_only(spark, tmp_path):
    text = "\\lx one\n\\de first\n\\lxid 7\n\\et old\n\\lx two\n\\de see \\lx one here\n\\et new\n"
    got = readers.starling(spark, write(tmp_path / "d.txt", text))
    assert sorted(rows(got, "headword", "definition", "etymology", "line_number")) == [
        ("one", "first", "old", 1), ("two", "see \\lx one here", "new", 5)]


def test_marker_files_in_many_splits(spark, tmp_path):
    """Records, their last values and line numbers do not depend on where a file is split."""
    want = []
    for f in range(2):
        lines = ["\\_sh", "\\de lost", ""]
        for i in range(60):
            want.append((f"w{f}.{i}", f"d{i}" * (i % 9 + 1), None if i % 3 else f"e{i}", len(lines) + 1))
            lines += [f"  \\lx w{f}.{i}", "\\de overwritten", *["more"] * (i % 40), f"\\de {want[-1][1]}", *([] if i % 3 else [f"\\et e{i}"])]
        write(tmp_path / f"{f}.txt", "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 97)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = readers.starling(spark, str(tmp_path))
        assert sorted(rows(got, "headword", "definition", "etymology", "line_number")) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
