"""The rule catalogue: clause types with keywords and red lines, held as data.

Rules are rows, not code. Loading validates everything and skips nothing: a missing
field, an unknown value, a repeated code or a pattern that does not compile is an error.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schemas import OBLIGATIONS, SEVERITIES

PLACEHOLDER = "{ALICI}"
TR = "a-zçğıöşü"
#: Turkish suffixes, of which the first that fits is cut, and final
#: consonants that soften before a suffix.
SUFFIXES = (
    "mesi", "ması", "mek", "mak", "me", "ma", "larinin", "lerinin", "larında", "lerinde", "larindan", "lerinden",
    "ları", "leri", "lar", "ler", "sının", "sinin", "sunun", "sünün", "nın", "nin", "nun", "nün", "ında", "inde",
    "unda", "ünde", "ının", "inin", "unun", "ünün", "dan", "den", "tan", "ten", "sı", "si", "su", "sü", "ın", "in",
    "un", "ün", "da", "de", "ta", "te", "ı", "i", "u", "ü",
)
SOFTENING = {"k": "[kğ]", "p": "[pb]", "ç": "[çc]", "t": "[td]", "g": "[gğ]"}
MIN_STEM = 5


class CatalogError(ValueError):
    """The catalogue is wrong; nothing was loaded."""


@dataclass(frozen=True)
class RedLine:
    id: str
    text: str
    severity: str = "YUKSEK"
    patterns: tuple[str, ...] = ()
    absent_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class ClauseType:
    code: str
    name: str
    category: str = "SOZLESMESEL"
    obligation: str = "ONERILEN"
    applies_to: tuple[str, ...] = ()
    weight: int = 3
    keywords: tuple[str, ...] = ()
    red_lines: tuple[RedLine, ...] = ()
    ideal_text: str = ""
    legal_basis: tuple[str, ...] = ()
    argument: str = ""
    severity_if_missing: str = "ORTA"
    plain: str = ""
    catalog_order: int = field(default=0, compare=False)


def tr_fold(s: str) -> str:
    table = str.maketrans("İIŞĞÜÖÇ’‘“” ", "iışğüöç''\"\" ")
    return " ".join(s.translate(table).lower().split())


def stem(word: str) -> str:
    """Cuts one suffix, the first of the list that fits, if enough of the word is left."""
    suffix = next((x for x in SUFFIXES if word.endswith(x)), "")
    return word[: len(word) - len(suffix)] if suffix and len(word) - len(suffix) >= MIN_STEM else word


def keyword_pattern(keyword: str) -> str:
    """A pattern for folded text: every word may take suffixes, and the first begins a word."""
    words = []
    for word in map(stem, tr_fold(keyword).split()):
        head, last = re.escape(word[:-1]), word[-1]
        words.append(head + SOFTENING.get(last, re.escape(last)) + f"[{TR}]*")
    return rf"(?iu)(?<![{TR}0-9])" + r"\s+".join(words) if words else "(?!)"


def _checked(pattern: str, where: str) -> str:
    try:
        re.compile(pattern.replace(PLACEHOLDER, "x"), re.IGNORECASE | re.DOTALL)
    except re.error as e:
        raise CatalogError(f"{where}: pattern {pattern!r} does not compile: {e}") from e
    return pattern


def parse(entry: dict, order: int = 0, source: str = "catalogue") -> ClauseType:
    code = entry.get("code", "?")
    for needed in ("code", "name_tr", "obligation"):
        if needed not in entry:
            raise CatalogError(f"{source}: {code} has no {needed}")

    def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
        if value not in allowed:
            raise CatalogError(f"{source}: {code} has {what} {value!r}, not one of {allowed}")
        return value

    found = entry.get("detection") or {}
    keywords = [k.strip() for k in [*found.get("keywords_tr", []), *found.get("keywords_en", [])] if k and k.strip()]
    lines = [
        RedLine(r["id"], r["text"], one_of(r.get("severity", "YUKSEK"), SEVERITIES, "severity"), *(tuple(_checked(p, f"{source}: {code}/{r['id']}") for p in r.get(k) or ()) for k in ("patterns", "absent_patterns")))
        for r in entry.get("red_lines") or ()
    ]
    text = lambda k: (entry.get(k) or "").strip()
    return ClauseType(
        code, entry["name_tr"], entry.get("category", "SOZLESMESEL"), one_of(entry["obligation"], OBLIGATIONS, "obligation"), tuple(entry.get("applies_to") or ()), int(entry.get("weight", 3)),
        tuple(tr_fold(k) for k in keywords), tuple(lines), text("ideal_text_tr"), tuple(entry.get("legal_basis") or ()), text("negotiation_argument_tr"),
        one_of(entry.get("severity_if_missing", "ORTA"), SEVERITIES, "severity_if_missing"), text("plain_tr"), order,
    )


def build(entries: list[dict], source: str = "catalogue") -> list[ClauseType]:
    types = [parse(e, i, source) for i, e in enumerate(entries)]
    codes = [t.code for t in types]
    if repeated := sorted({c for c in codes if codes.count(c) > 1}):
        raise CatalogError(f"{source}: repeated codes {repeated}")
    return types


def load(directory: str) -> list[ClauseType]:
    """All ``*.yaml`` and ``*.json`` lists of a directory in name order. Files that begin
    with an underscore map codes to plain-language texts, merged by code."""
    entries, plain = [], {}
    paths = sorted(p for p in Path(directory).iterdir() if p.suffix in (".yaml", ".yml", ".json"))
    if not any(not p.name.startswith("_") for p in paths):
        raise CatalogError(f"{directory} holds no catalogue")
    for path in paths:
        if path.suffix == ".json":
            data = json.loads(path.read_text("utf-8"))
        else:
            import yaml

            data = yaml.safe_load(path.read_text("utf-8"))
        if path.name.startswith("_"):
            plain |= {k: (v or "").strip() for k, v in (data or {}).items()}
        elif not isinstance(data or [], list):
            raise CatalogError(f"{path}: the root is not a list")
        else:
            entries += data or []
    return build([{"plain_tr": plain.get(e.get("code"), ""), **e} for e in entries], directory)


def to_frame(spark: SparkSession, types: list[ClauseType]) -> DataFrame:
    """One row a clause type; small by nature, so joins broadcast it."""
    rows = [(t.catalog_order, t.code, t.name, t.category, t.obligation, list(t.applies_to), t.weight, list(t.keywords), t.ideal_text, list(t.legal_basis), t.argument, t.severity_if_missing, t.plain) for t in types]
    return spark.createDataFrame(rows, "catalog_order int, code string, name string, category string, obligation string, applies_to array<string>, weight int, keywords array<string>, ideal_text string, legal_basis array<string>, argument string, severity_if_missing string, plain string")
