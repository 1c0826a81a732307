"""Metadata of a document from its text, and containment filters over it.

Metadata is a map from key to JSON-encoded scalar: ``"12"`` and ``12`` stay different, as
they do in a JSON document, and a filter is one equality per key.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .text import strip

EXTRACTOR_VERSION = "extractive-v2"
SAMPLE_CHARS = 4000
LEAST_CHARS = 40
LEAST_ALPHA = 0.5
FIRST_YEAR, LAST_YEAR = 1900, 2100
MOST_KEYS = 10
MOST_VALUE_CHARS = 256

# Names of months.
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}

# Classes in order of priority, with markers one of which is enough, and markers two of which are needed.
DOC_TYPES: list[tuple[str, list[str], list[str]]] = [
    ("invoice",
     ["invoice number", "invoice no", "número de factura", "numero de factura"],
     ["invoice", "factura", "subtotal", "amount due", "total a pagar", "bill to", "facturar a", "tax id", "iva", "vat", "payment terms", "condiciones de pago"]),
    ("contract",
     ["hereinafter referred to as", "witnesseth", "en fe de lo cual", "de una parte"],
     ["agreement", "contrato", "the parties", "las partes", "clause", "cláusula", "clausula", "shall be governed by", "se regirá por", "termination", "rescisión", "rescision", "obligations", "obligaciones"]),
    ("resume",
     ["curriculum vitae", "work experience", "experiencia laboral"],
     ["resume", "education", "formación académica", "formacion academica", "skills", "habilidades", "references available", "professional summary", "perfil profesional"]),
    ("email",
     ["-----original message-----", "mensaje original"],
     ["subject:", "asunto:", "from:", "de:", "to:", "para:", "cc:", "sent:"]),
    ("policy",
     ["privacy policy", "política de privacidad", "politica de privacidad"],
     ["policy", "política", "politica", "must comply", "debe cumplir", "scope", "alcance", "effective date", "fecha de vigencia", "applies to all"]),
    ("manual",
     ["user manual", "manual de usuario", "installation guide"],
     ["step 1", "paso 1", "troubleshooting", "solución de problemas", "solucion de problemas", "requirements", "requisitos", "getting started"]),
    ("report",
     ["executive summary", "resumen ejecutivo"],
     ["abstract", "resumen", "introduction", "introducción", "introduccion", "conclusions", "conclusiones", "methodology", "metodología", "metodologia", "figure 1", "figura 1", "findings", "hallazgos"]),
]
LEAST_MARKERS = 2
OTHER = "other"


def sample(text: Column) -> Column:
    return F.substring(text, 1, SAMPLE_CHARS)


def alpha_ratio(text: Column) -> Column:
    """Share of letters in a text; null for an empty one."""
    return F.length(F.regexp_replace(text, "\\P{L}", "")) / F.nullif(F.length(text), F.lit(0))


def can_detect_language(text: Column) -> Column:
    """The sample is long enough, and enough of it is letters."""
    return let(strip(sample(text)), lambda s: (F.length(s) >= LEAST_CHARS) & F.coalesce(alpha_ratio(s) >= LEAST_ALPHA, F.lit(False)))


_MONTH = "(" + "|".join(sorted(MONTHS, key=lambda m: (-len(m), m))) + ")"
# Date forms by precedence: pattern, then the groups of year, month and day.
DATE_FORMS = [
    ("(?U)\\b(\\d{4})-(\\d{2})-(\\d{2})\\b", (1, 2, 3)),
    (f"(?iuU)\\b(\\d{{1,2}})\\s+de\\s+{_MONTH}\\s+(?:de\\s+)?(\\d{{4}})\\b", (3, 2, 1)),
    (f"(?iuU)\\b{_MONTH}\\.?\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})\\b", (3, 1, 2)),
    (f"(?iuU)\\b(\\d{{1,2}})\\s+{_MONTH}\\.?,?\\s+(\\d{{4}})\\b", (3, 2, 1)),
]
#: What a text with a date of the form has, and most others have not: cheap to search for.
DATE_HINTS = ["\\d-\\d\\d-\\d\\d", "(?iU)\\d\\s+de\\s", "(?U)\\s\\d\\d?,?\\s+\\d{4}", "(?U)\\d\\s+\\p{L}{3,10}\\.?,?\\s+\\d{4}"]
#: The same with non-ASCII digits.
OTHER_DIGIT = "[\\p{Nd}&&[^0-9]]"


def dates_of_form(text: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    """The first valid date of a form, ``struct<start, day>``; null where there is none. The text is searched twice, for the matches and for what is between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    month_of = F.create_map(*(F.lit(x) for k, v in MONTHS.items() for x in (k, v)))
    parts = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, own: F.struct(F.length(gap).alias("gap"), own.alias("own")))

    def step(state: Column, p: Column) -> Column:
        y, m, d = (F.regexp_extract(p["own"], pattern, g) for g in groups)
        month = F.coalesce(F.try_element_at(month_of, F.lower(m)), m.try_cast("int"))
        year = y.cast("int")
        day = F.when(year.between(FIRST_YEAR, LAST_YEAR), F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, d.cast("int")), "yyyy-MM-dd"))
        start = state["at"] + p["gap"]
        first = F.when(state["first"].isNotNull(), state["first"]).otherwise(let(day, lambda x: F.when(x.isNotNull(), F.struct(start.alias("start"), x.alias("day")))))
        return F.struct((start + F.length(p["own"])).alias("at"), first.alias("first"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(None).cast("struct<start:int,day:date>").alias("first"))
    return F.aggregate(parts, begin, step, lambda s: s["first"])


def document_date(text: Column) -> Column:
    """The earliest date written in the sample, as ``yyyy-MM-dd``; of two forms at one place the earlier form."""

    def dated(s: Column) -> Column:
        # the hints decide for most texts; only those with something like the form are searched for it
        each = [F.when(s.rlike(hint) | s.rlike(OTHER_DIGIT), dates_of_form(s, p, g)) for (p, g), hint in zip(DATE_FORMS, DATE_HINTS, strict=True)]
        known = F.array_min(F.filter(F.transform(F.array(*each), lambda x, k: F.struct(x["start"].alias("start"), k.alias("form"), x["day"].alias("day"))), lambda x: x["start"].isNotNull()))
        return F.date_format(known["day"], "yyyy-MM-dd")

    s = sample(text)
    # one cheap test keeps texts without any year out of the four searches
    return F.when(s.rlike("[0-9]{4}") | s.rlike(OTHER_DIGIT), let(s, dated))


def doc_type(text: Column) -> Column:
    """Class of a document by its markers: the best score of two or more, the earlier class on a tie."""
    return let(F.lower(sample(text)), _type_of)


def _type_of(s: Column) -> Column:
    scores = []
    for k, (name, strong, weak) in enumerate(DOC_TYPES):
        any_strong = F.lit(False)
        for marker in strong:
            any_strong = any_strong | s.contains(marker)
        n = sum((s.contains(marker).cast("int") for marker in weak), F.lit(0))
        scores.append(F.struct(F.when(any_strong, LEAST_MARKERS).otherwise(n).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.when(F.length(strip(s)) < LEAST_CHARS, OTHER).when(best["score"] >= LEAST_MARKERS, best["name"]).otherwise(OTHER)


def json_string(c: Column) -> Column:
    """A string column as a JSON string."""
    escaped = F.regexp_replace(F.regexp_replace(c, "\\\\", "\\\\\\\\"), "\"", "\\\\\"")
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def metadata_map(text: Column, language: Column, mime: Column | None = None, method: Column | None = None) -> Column:
    """All metadata of a document; keys without a value are left out."""
    none = F.lit(None).cast("string")
    values = {"doc_type": doc_type(text), "extractor_version": F.lit(EXTRACTOR_VERSION), "language": language, "document_date": document_date(text), "mime_type": none if mime is None else F.nullif(mime, F.lit("")), "extraction_method": none if method is None else F.nullif(method, F.lit(""))}
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), json_string(v)))), lambda k, v: v.isNotNull())


def needs_refresh(metadata: Column) -> Column:
    """The stored extractor version differs, or there is none."""
    return ~F.coalesce(F.element_at(metadata, "extractor_version"), F.lit("")).eqNullSafe(F.lit(json.dumps(EXTRACTOR_VERSION)))


class InvalidFilter(ValueError):
    """A metadata filter that cannot be applied."""


def validate_filter(filters: dict | None) -> dict | None:
    """The filter, or None if it filters nothing; flat, with at most 10 keys and scalar values."""
    if not filters:
        return None
    if len(filters) > MOST_KEYS:
        raise InvalidFilter(f"at most {MOST_KEYS} keys, not {len(filters)}")
    for key, value in filters.items():
        if not (isinstance(key, str) and key):
            raise InvalidFilter("keys are non-empty strings")
        if not isinstance(value, str | int | float | bool):
            raise InvalidFilter(f"the value of {key!r} is not a string, number or boolean")
        if isinstance(value, float) and not math.isfinite(value):
            raise InvalidFilter(f"the value of {key!r} is no JSON number")
        if isinstance(value, str) and len(value) > MOST_VALUE_CHARS:
            raise InvalidFilter(f"the value of {key!r} has more than {MOST_VALUE_CHARS} characters")
    return filters


def json_scalar(value: str | int | float | bool) -> str:
    """Canonical JSON of a scalar: whole numbers have no fraction, so 12 and 12.0 are equal."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def contains(metadata: Column, filters: dict | None) -> Column:
    """Every key is there with the same value of the same JSON type."""
    out = F.lit(True)
    for key, value in (validate_filter(filters) or {}).items():
        out = out & F.coalesce(F.element_at(metadata, F.lit(key)) == json_scalar(value), F.lit(False))
    return out


def canonical_filter(filters: dict | None) -> str:
    """One text per filter: sorted keys, no spaces, ASCII."""
    return json.dumps(filters or {}, sort_keys=True, separators=(",", ":"))


def canonical_map(metadata: Column) -> Column:
    """Like :func:`canonical_filter` for a column: entries by key."""
    entries = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
