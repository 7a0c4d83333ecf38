"""Headings, clauses and units of small texts; units always tile the text."""

import pytest
from pyspark.sql import functions as F

from pactum.operators import segment

LINES = [
    ("MADDE 7 - TESLİM", ("madde", "7", "TESLİM")), ("8.2 Bedelin Ödenmesi", ("bare", "8.2", "Bedelin Ödenmesi")), ("3. GİZLİLİK", ("numeric", "3", "GİZLİLİK")),
    ("EK-4 ÜCRET TABLOSU", ("ek", "EK-4", "ÜCRET TABLOSU")), ("Article 12 Termination", ("article", "12", "Termination")), ("IV. Son Hükümler", ("roman", "IV", "Son Hükümler")),
    ("[[H]] 5. her ne yazarsa yazsın, kabul edilir.", ("numeric", "5", "her ne yazarsa yazsın, kabul edilir.")),
    ("02.03.2025 günü imzalandı", None), ("2.750,00 TL tutarında", None), ("Bu bir cümledir ve başlık olamaz.", None), ("42", None), ("", None), ("3. küçük harfle başlayan bir cümle.", None),
]
THREE = "KAPAK\nTaraflar burada.\n\nMADDE 1 - KONU\nBu maddede konu anlatılır ve yeterince uzundur, kırk karakterden fazla.\nMADDE 2 - SÜRE\nSözleşmenin süresi burada yazılıdır, bu da yeterince uzundur.\nMADDE 3 - SON\nSon maddenin gövdesi de kırk karakteri aşan bir cümle tutar.\nimza"
PARAGRAPHS = "Kısa giriş.\n\n" + "Uzun bir paragraf, seksen karakteri aşması için biraz daha yazılmış bir cümle daha taşır. " * 2 + "\n\nkısa\n\n" + "İkinci uzun paragraf da seksen karakteri aşacak kadar uzun tutulmuştur, hem de fazlasıyla." + "\n\nkaşe"
TINY = "".join(f"MADDE {k} - X\nab\n" for k in range(1, 5)) + "MADDE 5 - SON\n" + "yeterince uzun bir gövde, kırk karakterden fazla tutar."
TEXTS = {"three": THREE, "paragraphs": PARAGRAPHS, "tiny": TINY, "one": "tek satır", "blank": " \n ", "empty": "", "null": None, "preamble": "yalnız giriş\n" * 3}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "contract_id string, text string")


@pytest.fixture(scope="module")
def units(docs):
    out = {}
    for r in segment.units(docs).orderBy("contract_id", "order_index").collect():
        out.setdefault(r["contract_id"], []).append(r)
    return out


def test_headings(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(LINES)], "i int, line string")
    got = {r["i"]: r["h"] for r in df.select("i", segment.heading(F.col("line")).alias("h")).collect()}
    assert [None if got[i] is None else tuple(got[i]) for i in range(len(LINES))] == [want for _, want in LINES]


def test_units_tile_the_text(docs, units):
    for name, rows in units.items():
        ends = [r["char_end"] for r in rows]
        assert [r["char_start"] for r in rows] == [0, *ends[:-1]] and ends[-1] == len(TEXTS[name])
        assert [r["order_index"] for r in rows] == list(range(len(rows)))
    assert set(units) >= {"three", "paragraphs", "tiny", "one", "preamble"} and not {"empty", "null"} & set(units)
    assert segment.coverage_violations(segment.units(docs), docs).collect() == []


def test_clauses(units):
    assert [(r["kind"], r["number"], r["heading"]) for r in units["three"] if not r["is_gap"]] == [("madde", "1", "KONU"), ("madde", "2", "SÜRE"), ("madde", "3", "SON")]
    first = units["three"][0]
    assert first["is_gap"] and first["heading"] == "Başlık ve taraflar" and "Taraflar burada." in first["text"]
    assert [r["number"] for r in units["paragraphs"] if not r["is_gap"]] == ["1", "2"]
    assert units["paragraphs"][-1]["is_gap"] and units["paragraphs"][-1]["heading"] == "İmza bloğu"


def test_offsets_point_at_the_heading(units):
    for r in units["three"]:
        if not r["is_gap"]:
            assert TEXTS["three"][r["char_start"] : r["char_end"]].startswith(f"MADDE {r['number']}")


def test_violations_are_found(spark, docs):
    rows = [("three", 0, 10), ("three", 12, 30), ("three", 25, 40), ("one", 0, len(TEXTS["one"]))]
    bad = segment.coverage_violations(spark.createDataFrame(rows, "contract_id string, char_start int, char_end int"), docs.filter("contract_id in ('three', 'one')"))
    assert sorted((r["at"], r["problem"]) for r in bad.collect()) == [(12, "gap"), (25, "overlap"), (40, "end")]
