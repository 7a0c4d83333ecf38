"""Parties, amounts, terms and defined terms of small contracts."""

import pytest
from pyspark.sql import functions as F

from pactum.operators import meta

TWO = (
    "KİRALAMA SÖZLEŞMESİ\n\nİşbu Sözleşme, bir tarafta Kuzey Katılım Bankası A.Ş. (\"KUZEY KATILIM\") ile diğer tarafta "
    "Poyraz Bulut Çözümleri A.Ş. (\"HİZMET SAĞLAYICI\") arasında akdedilmiştir. Sözleşme süresi 24 (yirmi dört) aydır. "
    "Bedel 1.250.000,50 TL olarak ödenir. Sözleşme kendiliğinden bir yıl daha uzar. Damga vergisi eşit ödenir."
)
BUYER = "İşbu Sözleşme, bir tarafta Erguvan Finans Kurumu A.Ş. (\"ERGUVAN FİNANS\") ile diğer tarafta Selvi Donanım Ltd. Şti. (\"SATICI\") arasında."
NONE = "YAZILIM LİSANS metni, taraf adı yok."


@pytest.fixture(scope="module")
def found(spark):
    rows = [("two", TWO), ("buyer", BUYER), ("none", NONE), ("null", None), ("empty", ""), ("many", " ".join(f"Firma{c} Örnek Teknoloji A.Ş., " for c in "ABCDEFGH"))]
    return {r["contract_id"]: r for r in meta.extract_meta(spark.createDataFrame(rows, "contract_id string, text string")).collect()}


def test_parties(found):
    assert found["two"]["parties"] == ["Kuzey Katılım Bankası A.Ş", "Poyraz Bulut Çözümleri A.Ş"]
    assert found["buyer"]["parties"] == ["Erguvan Finans Kurumu A.Ş", "Selvi Donanım Ltd. Şti"]
    assert [found[k]["parties"] for k in ("none", "null", "empty")] == [[], [], []]
    assert len(found["many"]["parties"]) == 6


def test_counterparty(found):
    assert found["two"]["counterparty"] == "Poyraz Bulut Çözümleri A.Ş"
    assert found["buyer"]["counterparty"] == "Selvi Donanım Ltd. Şti"
    assert [found[k]["counterparty"] for k in ("none", "null", "empty")] == ["", "", ""]


def test_amount_term_and_flags(found):
    assert found["two"]["value_text"] == "1.250.000,50 TL"
    assert found["two"]["term_text"] == "24 ay" and found["two"]["auto_renew"]
    assert found["two"]["stamp_duty"] == "Eşit paylaşım" and found["none"]["stamp_duty"] == "Sözleşmede düzenlenmemiş"
    assert found["two"]["terms"] == ["KUZEY KATILIM", "HİZMET SAĞLAYICI"]


def test_lead_words_go_to_a_fixpoint(spark):
    texts = ["İşbu sözleşme Meltem Gıda A.Ş. tarafından", "ve ile taraflar: Meltem Gıda A.Ş. için", "Sözleşme, - Meltem Gıda A.Ş."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["p"] for r in df.select(meta.parties(F.col("t")).alias("p")).collect()] == [["Meltem Gıda A.Ş"]] * 3
