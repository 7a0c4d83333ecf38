"""Labels written down by hand: short notices name their own license and no other."""

import pytest

from pactum.llm import license_scan

CASES = [
    ("released under the gnu license", ""), ("the license was released last year under a tree", ""), ("licensed under cc by 4 0", ""), ("cc by sa 4 0", ""), ("gnu general public license version 2", ""),
    ("this work is licensed under the gnu general public license version 2", ""), ("Released under the MIT License.", "mit"), ("released under the Apache License", ""), ("license mit the under released", ""),
    ("Licensed under the Apache License, Version 2.0", "apache-2"), ("This work is licensed under the GNU General Public License version 3.", "gpl-3"), ("licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"), ("", ""), (None, ""), ("mit", ""),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    ("Redistribution and use in binary and source forms, with or without any modification, are allowed if these conditions hold", ""),
]


def test_labels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_a_notice_has_two_words(spark):
    with pytest.raises(ValueError):
        license_scan.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), [("x", "word")])
