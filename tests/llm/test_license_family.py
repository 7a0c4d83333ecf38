"""Notices of the GNU licenses, whose versions one word tells apart, name the family and no version."""

from pactum.llm import license_scan

HEAD = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
CASES = [HEAD.format("General Public License", 2), HEAD.format("General Public License", 3), HEAD.format("Affero General Public License", 3), HEAD.format("Lesser General Public License", "2.1")]


def test_no_version_is_made_up(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()} == dict.fromkeys(range(len(CASES)), "gpl")
