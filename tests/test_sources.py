"""Files in, reports out, and the catalogue's errors."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pactum.operators import classify, rules
from pactum.sources import catalog, files, sinks

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx(paragraphs):
    p = lambda text, style: f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(p(t, s) for t, s in paragraphs)}{table}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("uploads")
    (at / "sub").mkdir()
    for name, content in {
        "a b.txt": "Düz metin\nikinci satır".encode(), "sub/c.md": b"# baslik", "d.docx": _docx([("MADDE 1", "Heading1"), ("g" * 120, "")]), "short.docx": _docx([("x", "")]), "bad.docx": b"no zip",
        "e.exe": b"MZ", "empty.txt": b"", "f.pdf": b"%PDF-1.4 nothing",
    }.items():
        (at / name).write_bytes(content)
    return str(at)


def test_scan_and_extract(spark, folder):
    scanned = files.scan(spark, folder)
    rows = {r["filename"]: r for r in scanned.drop("content").collect()}
    assert set(rows) == {"a_b.txt", "c.md", "d.docx", "short.docx", "bad.docx", "e.exe", "f.pdf"}
    assert rows["e.exe"]["problem"] == "unknown suffix" and rows["c.md"]["problem"] is None
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): r for r in files.extract(scanned).collect()}
    assert got["a b.txt"]["text"] == "Düz metin\nikinci satır" and got["c.md"]["error"] is None
    assert got["d.docx"]["text"] == "[[H]] MADDE 1\n" + "g" * 120 + "\na | b"
    assert [tuple(p) for p in got["d.docx"]["page_map"]] == [(1, 0, len(got["d.docx"]["text"]))]
    assert all(got[n]["error"] and got[n]["text"] is None for n in ("short.docx", "bad.docx", "e.exe", "f.pdf"))


def test_uploads_as_a_stream(spark, folder):
    run = files.scan(spark, folder, stream=True).select("filename", "problem").writeStream.format("memory").queryName("uploads").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("uploads").count() == 7


FINDING = "contract_id string, clause_number string, title string, severity string, confidence double, quote string, quote_is_evidence boolean, proposed_text string, finding_type string"
FINDINGS = [
    ("c1", "2", "low", "DUSUK", 0.9, "", False, "insert me", "WEAK"), ("c1", "1", "<top>", "KRITIK", 0.8, "old & bad", True, "new", "RED_LINE"),
    ("c1", "3", "info", "BILGI", 0.9, "q", True, "x", "INFO"), ("c2", "1", "plain", "ORTA", 0.5, "q", False, None, "WEAK"),
]


def test_reports(spark, tmp_path):
    findings = spark.createDataFrame(FINDINGS, FINDING)
    contracts = spark.createDataFrame([("c1", 40.0, "KIRMIZI"), ("c2", 90.0, "YESIL"), ("c3", 100.0, "YESIL")], "contract_id string, score double, band string")
    sinks.write_json_reports(sinks.report_payload(contracts, findings), str(tmp_path / "json"))
    got = {r["contract_id"]: json.loads(r["payload"]) for r in spark.read.json(str(tmp_path / "json")).collect()}
    assert [f["severity"] for f in got["c1"]["findings"]] == ["KRITIK", "DUSUK", "BILGI"] and "findings" not in got["c3"]
    html = {r["contract_id"]: r["html"] for r in sinks.html_report(contracts, findings).collect()}
    assert html["c1"].index("&lt;top&gt;") < html["c1"].index("low") and "old &amp; bad" in html["c1"] and "<p>-</p>" in html["c3"]


def test_redlines(spark):
    got = {(r["contract_id"], r["seq"]): [(o["op"], o["text"]) for o in r["operations"]] for r in sinks.redline_operations(spark.createDataFrame(FINDINGS, FINDING)).collect()}
    assert got == {("c1", 1): [("delete", "old & bad"), ("insert", "new")], ("c1", 2): [("insert", "insert me")]}


def test_idempotent_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    sinks.replace_partitions(first, path, "k")
    sinks.replace_partitions(spark.createDataFrame([("a", 2)], "k string, v int"), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]
    audit = spark.createDataFrame([("2024-01-02 10:00:00", "x")], "at string, action string").withColumn("at", F.to_timestamp("at"))
    for _ in range(2):
        sinks.append_audit(audit, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    old = spark.createDataFrame([("c", "json", "p1", 1), ("c", "html", "p2", 2)], "contract_id string, fmt string, path string, size int")
    new = spark.createDataFrame([("c", "json", "p3", 3)], old.schema)
    assert {(r["fmt"], r["path"]) for r in sinks.manifest(new, old).collect()} == {("json", "p3"), ("html", "p2")}


GOOD = {"code": "A", "name_tr": "a", "obligation": "ZORUNLU"}


@pytest.mark.parametrize("entry", [{"code": "A", "name_tr": "a"}, GOOD | {"obligation": "?"}, GOOD | {"severity_if_missing": "?"}, GOOD | {"red_lines": [{"id": "r", "text": "t", "patterns": ["("]}]}, GOOD | {"red_lines": [{"id": "r", "text": "t", "severity": "?"}]}])
def test_catalogue_errors(entry):
    with pytest.raises(catalog.CatalogError):
        catalog.build([entry])


def test_catalogue_files(tmp_path):
    (tmp_path / "1.json").write_text(json.dumps([GOOD]), "utf-8")
    (tmp_path / "_plain.json").write_text(json.dumps({"A": "sade"}), "utf-8")
    assert [(t.code, t.plain) for t in catalog.load(str(tmp_path))] == [("A", "sade")]
    (tmp_path / "2.json").write_text(json.dumps([GOOD]), "utf-8")
    with pytest.raises(catalog.CatalogError):
        catalog.load(str(tmp_path))
    with pytest.raises(catalog.CatalogError):
        catalog.load(str(tmp_path / "none") if (tmp_path / "none").mkdir() is None else "")


#: keyword, text, whether it hits; written for the rules of suffixes and softening.
KEYWORDS = [
    ("yedekleme", "günlük yedeklemeler alınır", True), ("sözleşme bedeli", "Sözleşmenin   bedelini öder", True), ("kitap", "kitabı geri verir", True), ("ek", "tek başına", False), ("ek", "ekler geçerlidir", True),
    ("fesih", "FESİH hakkı", True), ("gizli", "(gizli) kalır", True), ("ödeme planı", "ödeme-planı", False), ("sla", "\"SLA\" hedefi", True), ("a", "bir a harfi", True), ("ışık", "IŞIK kaynağı", True),
]


def test_keywords(spark):
    types = catalog.build([GOOD | {"code": f"K{i}", "detection": {"keywords_tr": [k]}} for i, (k, *_) in enumerate(KEYWORDS)])
    clauses = spark.createDataFrame([("c", i, "", t) for i, (_, t, _) in enumerate(KEYWORDS)] + [("c", 99, "FESİH", "")], "contract_id string, order_index int, heading string, text string")
    got = {(r["order_index"], r["code"]): (r["in_heading"], r["n"]) for r in classify.keyword_hits(clauses, types).collect()}
    for i, (_, _, hits) in enumerate(KEYWORDS):
        assert ((i, f"K{i}") in got) is hits, KEYWORDS[i]
    assert got[99, "K5"] == (True, 0)


def test_ambiguous_phrases(spark):
    df = spark.createDataFrame([("Makul çabayı gösterir", "SLA"), ("derhal bildirir", "SLA"), ("derhal bildirir", "PAY"), ("Zaman ZAMAN ve benzeri", None), ("MAKUL CABA", "PAY")], "t string, c string")
    got = [sorted((x["phrase"], x["kind"]) for x in r["a"]) for r in df.select(rules.ambiguous(F.col("t"), F.col("c")).alias("a")).collect()]
    assert got == [[("makul çaba", "zayiflatici")], [("derhal", "sure")], [], [("ve benzeri", "zayiflatici"), ("zaman zaman", "zayiflatici")], [("makul çaba", "zayiflatici")]]


def test_rules_on_sentences(spark):
    texts = ["Bilgi paylaşılamaz; kopyalanması yasaktır.", "Bilgi, önceden yazılı onay ile paylaşılır.", "Bilgi serbestçe paylaşılır."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["x"] for r in df.select(rules.reversed_direction(F.col("t")).alias("x")).collect()] == [True, True, False]
    refs = spark.createDataFrame([("Ekler: EK-2 ve EK-3 geçerlidir, EK-10 da.\nEK-2 Liste\n",)], "t string")
    assert refs.select(rules.missing_annexes(F.col("t")).alias("x")).first()["x"] == [3, 10]
