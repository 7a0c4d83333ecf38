"""The whole analysis on hand-made contracts, from raw text to bands."""

import time

import pytest

from pactum.plans import analysis
from pactum.sources import catalog

ENTRIES = [
    {"code": "PAY", "name_tr": "Ödeme", "obligation": "ZORUNLU", "weight": 3, "category": "TICARI_RISK", "severity_if_missing": "YUKSEK", "detection": {"keywords_tr": ["ödeme", "fatura"]},
     "red_lines": [{"id": "PAY_ADVANCE", "text": "peşin ödeme", "severity": "KRITIK", "patterns": ["peşin\\s+(?:olarak\\s+)?öde"]}, {"id": "PAY_NO_DAYS", "text": "vade yok", "severity": "ORTA", "absent_patterns": ["\\d+\\s*gün"]}]},
    {"code": "SECRECY", "name_tr": "Gizlilik", "obligation": "ZORUNLU", "weight": 5, "category": "VERI_GUVENLIK", "severity_if_missing": "KRITIK", "detection": {"keywords_tr": ["gizlilik", "gizli bilgi"]},
     "red_lines": [{"id": "SEC_SHARE", "text": "bilgi paylaşımı", "severity": "YUKSEK", "patterns": ["bilgileri.{0,40}paylaş", "{ALICI}.{0,30}verilerini"]}]},
    {"code": "SLA", "name_tr": "Hizmet seviyesi", "obligation": "ONERILEN", "weight": 4, "category": "OPERASYONEL", "detection": {"keywords_tr": ["hizmet seviyesi"]}, "red_lines": []},
]
RISKY = (
    "HİZMET SÖZLEŞMESİ\nLodos Bankası A.Ş. (\"LODOS\") ile Karayel Yazılım A.Ş. (\"TEDARİKÇİ\") arasında.\n"
    "MADDE 1 - ÖDEME\nBedelin tamamı fatura beklenmeden peşin ödenir. Ödeme makul çaba ile yapılır ve gecikmez.\n"
    "MADDE 2 - GİZLİLİK\nTedarikçi, edindiği bilgileri üçüncü kişilerle paylaşabilir; gizli bilgi sayılmaz.\n"
    "MADDE 3 - SON HÜKÜMLER\nBu sözleşme EK-7 ile bir bütündür. Masrafların tamamı tarafından karşılanır. Adres: ......... olur.\n"
)
FAIR = (
    "MADDE 1 - ÖDEME\nFatura tarihinden itibaren 30 gün içinde ödeme yapılır, başka bir koşul aranmaz.\n"
    "MADDE 2 - GİZLİLİK\nTedarikçi edindiği bilgileri hiç kimseyle paylaşamaz; gizli bilgi süresiz korunur.\n"
    "MADDE 3 - SÜRE\nSözleşme iki yıl süreyle geçerlidir ve kendiliğinden sona erer, uzatılmaz.\n"
)


@pytest.fixture(scope="module")
def types():
    return catalog.build(ENTRIES, "test")


@pytest.fixture(scope="module")
def result(spark, types):
    rows = [("risky", RISKY, True), ("fair", FAIR, True), ("empty", "", False), ("null", None, None)]
    return analysis.analyse(spark.createDataFrame(rows, "contract_id string, raw_text string, involves_personal_data boolean"), types)


@pytest.fixture(scope="module")
def findings(result):
    return {(r["contract_id"], r["finding_type"], r["code"], r["title"]): r for r in result.findings.collect()}


def test_findings_of_a_risky_contract(findings):
    own = {k[1:]: r for k, r in findings.items() if k[0] == "risky"}
    assert ("RED_LINE", "PAY", "peşin ödeme") in own and "peşin ödenir" in own["RED_LINE", "PAY", "peşin ödeme"]["quote"]
    assert ("WEAK", "PAY", "vade yok") in own and not own["WEAK", "PAY", "vade yok"]["quote_is_evidence"]
    assert ("RED_LINE", "SECRECY", "bilgi paylaşımı") in own
    assert ("AMBIGUOUS", "PAY", "makul çaba") in own
    assert ("CROSS_REF_ERROR", "ENTIRE_AGREEMENT", "EK-7") in own
    assert own["CROSS_REF_ERROR", "ENTIRE_AGREEMENT", "EK-7"]["severity"] == "ORTA"
    assert {t for kind, _, t in own if kind == "DRAFTING_DEFECT"} == {"SUBJECT"}
    assert not any(kind == "MISSING" for kind, *_ in own)
    assert own["RED_LINE", "SECRECY", "bilgi paylaşımı"]["score"] == pytest.approx(round(3.0 * 5 * 1.25 * 0.85, 2))


def test_what_stands_nowhere_is_dropped_with_its_reason(result):
    """A blank is quoted with ellipses around it, so its quote is not found in the text."""
    assert {(r["contract_id"], r["title"], r["reason"]) for r in result.dropped.collect()} == {("risky", "BLANK", "alinti kaynak metinde bulunamadi")}


def test_a_forbidding_sentence_is_no_red_line(findings):
    assert not [k for k in findings if k[0] == "fair" and k[1] in ("RED_LINE", "WEAK")]


def test_empty_texts_miss_all_mandatory_types(findings):
    for name in ("empty", "null"):
        assert {k[2] for k in findings if k[0] == name and k[1] == "MISSING"} == {"PAY", "SECRECY"}


def test_bands(result):
    got = {r["contract_id"]: r for r in result.scores.collect()}
    assert set(got) == {"risky", "fair", "empty", "null"}
    assert got["risky"]["band"] == "KIRMIZI" and got["risky"]["red_lines"] == 2
    assert got["fair"]["band"] == "YESIL" and got["fair"]["score"] == 100.0


def test_quotes_stand_in_the_text(result):
    texts = {r["contract_id"]: r["text"] for r in result.normalized.collect()}
    rows = [r for r in result.findings.collect() if r["finding_type"] in ("RED_LINE", "AMBIGUOUS")]
    assert rows and all(r["quote"] in texts[r["contract_id"]] for r in rows)


def test_verdicts_drop_a_gap(spark, types):
    contracts = spark.createDataFrame([("c", FAIR.replace("GİZLİLİK", "DİĞER").replace("gizli bilgi", "her şey").replace("bilgileri", "şeyleri"))], "contract_id string, raw_text string")
    told = spark.createDataFrame([("c", "SECRECY", "VAR")], "contract_id string, code string, status string")
    missing = lambda **how: {r["code"] for r in analysis.analyse(contracts, types, **how).findings.filter("finding_type = 'MISSING'").collect()}
    assert missing() == {"SECRECY"} and missing(verdicts=told) == set()


def test_one_contract_takes_seconds(spark, types):
    contracts = spark.createDataFrame([("c", RISKY)], "contract_id string, raw_text string")
    start = time.monotonic()
    assert analysis.analyse(contracts, types).scores.count() == 1
    assert time.monotonic() - start < 60


def test_report_sections(spark, types, result, tmp_path):
    """Every section of a report as a dataset, and all of them on one page with its text escaped."""
    from pactum.plans import report

    catalogue = catalog.to_frame(spark, [type(t)(**{**t.__dict__, "plain": f"{t.name} <sade>"}) for t in types])
    parts = report.sections(result, catalogue)
    report.write_sections(parts, f"file://{tmp_path}/sections")
    rows = {name: [r for r in spark.read.parquet(f"file://{tmp_path}/sections/{name}").orderBy("contract_id", "seq").collect()] for name in parts}
    of = lambda name, who: [r for r in rows[name] if r["contract_id"] == who]
    assert [r["severity"] for r in of("actions", "risky")][:1] == ["KRITIK"] and len(of("actions", "risky")) == report.ACTIONS
    assert {r["code"] for r in of("gaps", "empty")} == {"PAY", "SECRECY"} and not of("gaps", "risky")
    assert [r["name"] for r in of("glossary", "risky")] == sorted(r["name"] for r in of("glossary", "risky")) and of("glossary", "risky")
    assert all(r["calls"] == r["failed"] and r["tokens"] == 0 and r["bar"] == 0 and r["first_error"] == "no model" for r in rows["usage"]) and rows["usage"]
    shown = {(r["contract_id"], r["heading"]) for r in rows["unreviewed"]}
    assert shown == {(r["contract_id"], r["heading"]) for r in result.classified.collect() if not r["codes"]} and shown
    html = {r["contract_id"]: r["html"] for r in report.pages(result, parts).collect()}
    assert set(html) == {"risky", "fair", "empty", "null"} and "<sade>" not in html["risky"] and "&lt;sade&gt;" in html["risky"]
    assert "Eksik maddeler" in html["empty"] and "Eksik maddeler" not in html["risky"] and "KIRMIZI" in html["risky"]
