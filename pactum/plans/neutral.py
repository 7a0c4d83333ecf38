"""A small neutral catalogue for corpora in no particular language; the queries over the
shared tables use it, and their SQL says the same in DuckDB's words."""

from __future__ import annotations

from ..sources.catalog import build

ENTRIES = [
    {"code": "LICENSING", "name_tr": "Licence", "obligation": "ZORUNLU", "weight": 4, "category": "REGULASYON", "severity_if_missing": "YUKSEK", "detection": {"keywords_en": ["license", "licensed under", "version"]},
     "red_lines": [{"id": "LIC_NC", "text": "no commercial use", "severity": "KRITIK", "patterns": ["by.nc", "non.?commercial"]}, {"id": "LIC_NO_VERSION", "text": "no version named", "severity": "ORTA", "absent_patterns": ["version"]}]},
    {"code": "SECRETS", "name_tr": "Secrets", "obligation": "ZORUNLU", "weight": 5, "category": "VERI_GUVENLIK", "severity_if_missing": "DUSUK", "detection": {"keywords_en": ["token", "password"]},
     "red_lines": [{"id": "SEC_TOKEN", "text": "a token in the text", "severity": "KRITIK", "patterns": ["token *= *\"[0-9a-f]{8}"]}]},
    {"code": "ENGLISH", "name_tr": "English words", "obligation": "ONERILEN", "weight": 1, "category": "SOZLESMESEL", "detection": {"keywords_en": ["the", "which", "of the"]}, "red_lines": []},
    {"code": "GERMAN", "name_tr": "German words", "obligation": "ONERILEN", "weight": 2, "category": "SOZLESMESEL", "detection": {"keywords_en": ["und", "der", "die"]},
     "red_lines": [{"id": "GER_NO_DAS", "text": "never says das", "severity": "DUSUK", "absent_patterns": ["das"]}]},
]
TYPES = build(ENTRIES, "neutral")
