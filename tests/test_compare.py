"""Alignment of versions: every unit once, the kinds of change, diffs that rebuild the texts."""

import itertools

import pytest
from pyspark.sql import functions as F

from pactum.operators import compare, segment


def _art(n, head, body):
    return f"MADDE {n} - {head}\n{body}\n"


BODIES = ["Birinci maddenin gövdesi burada durur ve yeterince uzundur.", "İkinci madde bedeli aylık 100.000 TL olarak belirler.", "Üçüncü maddede taraflar sır saklamayı kabul eder.", "Dördüncü madde yürürlük gününü yazar, başka bir şey demez."]
BASE = "".join(_art(k + 1, f"B{k}", b) for k, b in enumerate(BODIES))
PAIRS = {
    "same": (BASE, BASE), "added": (BASE, BASE + _art(5, "EK HÜKÜM", "Yepyeni bir hüküm, daha önce hiç yoktu burada.")),
    "removed": (BASE, "".join(_art(k + 1, f"B{k}", b) for k, b in enumerate(BODIES) if k != 2)),
    "changed": (BASE, BASE.replace("100.000", "140.000")), "unlike": (_art(3, "GİZLİLİK", "Taraflar sırlarını karşılıklı korur."), _art(3, "FESİH", "Otuz gün önceden bildirimle sona erer.")),
    "moved": (BASE, BASE.replace("MADDE 4", "MADDE 9")), "spaces": (BASE, BASE.replace("maddenin gövdesi", "maddenin   gövdesi")), "repeated": (BASE + BASE, BASE),
}


@pytest.fixture(scope="module")
def units(spark):
    sides = []
    for side in (0, 1):
        docs = spark.createDataFrame([(k, p[side]) for k, p in PAIRS.items()], "comparison_id string, text string")
        sides.append(segment.units(docs, "comparison_id").cache())
    return sides


@pytest.fixture(scope="module")
def changes(units):
    out = {}
    for r in compare.align(*units).orderBy("comparison_id", "order_index").collect():
        out.setdefault(r["comparison_id"], []).append(r)
    return out


def test_every_unit_once(units, changes):
    for at, side in zip(("i", "j"), units, strict=True):
        want = {}
        for r in side.collect():
            want.setdefault(r["comparison_id"], []).append(r["order_index"])
        for k in PAIRS:
            assert sorted(r[at] for r in changes[k] if r[at] is not None) == sorted(want[k])


def test_kinds(changes):
    kinds = {k: [r["change_type"] for r in rows] for k, rows in changes.items()}
    assert set(kinds["same"]) == {"AYNI"} and not any(r["significant"] for r in changes["same"])
    assert kinds["added"].count("EKLENDI") == 1 and set(kinds["added"]) == {"AYNI", "EKLENDI"}
    assert kinds["removed"].count("SILINDI") == 1 and set(kinds["removed"]) <= {"AYNI", "SILINDI", "TASINDI"}
    assert kinds["changed"].count("DEGISTI") == 1 and set(kinds["changed"]) == {"AYNI", "DEGISTI"}
    assert set(kinds["unlike"]) == {"SILINDI", "EKLENDI"}
    assert kinds["moved"].count("TASINDI") == 1
    assert not any(r["significant"] for r in changes["spaces"])


def test_diffs_rebuild_both_texts(changes):
    for r in itertools.chain(*changes.values()):
        if r["change_type"] in ("DEGISTI", "TASINDI"):
            join = lambda ops, d=r["word_diff"]: "".join(p["text"] for p in d if p["op"] in ops)
            assert join(("equal", "delete")).split() == r["old_text"].split() and join(("equal", "insert")).split() == r["new_text"].split()
    [changed] = [r for r in changes["changed"] if r["change_type"] == "DEGISTI"]
    assert "140.000" in "".join(p["text"] for p in changed["word_diff"] if p["op"] == "insert")


def test_stats_add_up(units):
    for r in compare.change_stats(compare.align(*units)).collect():
        assert sum(r[k] for k in ("EKLENDI", "SILINDI", "DEGISTI", "TASINDI", "AYNI")) == r["toplam"]


def test_gray_pairs_need_a_verdict(spark):
    unit = "comparison_id string, order_index int, number string, heading string, text string, is_gap boolean"
    old = spark.createDataFrame([("c", 0, "", "", "alpha beta gamma delta epsilon zeta", False)], unit)
    new = spark.createDataFrame([("c", 0, "", "", "alpha beta gamma other words here", False)], unit)
    kinds = lambda **how: sorted(r["change_type"] for r in compare.align(old, new, **how).collect())
    verdict = lambda same: spark.createDataFrame([("c", 0, 0, same)], "comparison_id string, i int, j int, same boolean")
    assert kinds() == kinds(verdicts=verdict(False)) == ["EKLENDI", "SILINDI"]
    assert kinds(verdicts=verdict(True)) == ["DEGISTI"]


def test_bounds_never_lose_a_pair(spark):
    texts = ["", "a", "a a a", "a b c d", "d c b a", "a b x y", "x y z", "a b c d e f g h", "a b c d e f g i"]
    df = spark.createDataFrame(list(itertools.product(texts, texts)), "x string, y string")
    a, b = compare.match_key(F.col("x")), compare.match_key(F.col("y"))
    for r in df.select("x", "y", compare.similarity(F.col("x"), F.col("y")).alias("s"), compare.may_reach(a, b, compare.GRAY).alias("may")).collect():
        assert r["may"] or r["s"] < compare.GRAY, r


def test_triage(spark, units):
    changes = compare.align(*units).filter("comparison_id = 'changed'")
    at = next(r["order_index"] for r in changes.collect() if r["change_type"] == "DEGISTI")
    verdicts = spark.createDataFrame([("changed", at, "DUSUK", "ALEYHE", "bedel 140.000 oldu"), ("changed", 0, None, "??", "bedel 7 oldu")], "comparison_id string, order_index int, materiality string, impact string, explanation string")
    got = {r["order_index"]: r for r in compare.triage(changes, verdicts).collect()}
    assert (got[at]["materiality"], got[at]["impact"], got[at]["verification"]) == ("DUSUK", "ALEYHE", "VERIFIED")
    assert (got[0]["materiality"], got[0]["impact"], got[0]["verification"]) == ("YOK", "NOTR", "REJECTED")
    assert all(r["verification"] == "TEMPLATE" and r["impact"] == "NOTR" for k, r in got.items() if k not in (0, at))
