"""Column functions on titles, keys and texts; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in titles, and words that mark a language.
STOP = [
    "gen", "feb", "mar", "apr", "mag", "giu", "lug", "ago", "set", "ott", "nov", "dic", "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december", "from", "invoice", "fattura", "bill", "bolletta", "receipt", "receipts", "payment", "payments", "statement",
    "statements", "accounting", "record", "records", "estratto", "conto", "estimate", "preventivo", "quote", "quotations", "construction", "works", "work", "cost",
    "spese", "riparto", "consuntivo", "rendiconto", "final", "ordinary", "management", "for", "the", "and", "del", "della", "delle", "dei", "di", "comune", "condominio",
    "condominium", "building", "permit", "administrative", "administration", "administrator", "amministrazione", "amministratore", "declaration", "communication",
    "corrispondenza", "correspondence", "notice", "notification", "privacy", "data", "protection", "compliance", "maintenance", "relationship", "issue", "financial",
    "period", "balance", "budget", "utility", "utilities", "electricity", "water", "gas", "natural", "general", "matter", "case", "file", "document", "documents",
    "contract", "supply", "service", "services", "protocols", "guarantees", "tariffe", "tariff", "tariffs", "conditions", "schedule", "online", "access", "activation",
    "updates", "tax", "tarsu", "ici", "rai", "license", "licence", "property", "registration", "cadastral", "catasto", "catasti", "spa", "srl", "snc", "ltd",
]
MARKS = {"it": [" il ", " di ", " che ", " della "], "en": [" the ", " of ", " and ", " is "]}
ACCENTS = "àèéìòù"


def slug(x: Column, sep: str = "-", size: int = 255, empty: str = "topic") -> Column:
    """Lower case, runs of anything but a-z and 0-9 as ``sep``, trimmed and bounded; ``empty`` if nothing is left."""
    out = F.left(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", ""), F.lit(size))
    return F.when(F.coalesce(out, F.lit("")) == "", empty).otherwise(out)


def tokens(x: Column, least: int = 3) -> Column:
    """Distinct runs of a-z and 0-9 of at least ``least`` letters, without numbers and stop words, in order of place."""
    found = F.split(F.lower(x), "[^a-z0-9]+")
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$") & ~t.isin(STOP)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def occurrences(x: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("int")


def language(x: Column) -> Column:
    """``it`` or ``en`` by marker words, accents counting three for Italian; ties are Italian."""
    text = F.lower(x)
    it = sum((occurrences(text, m) for m in MARKS["it"]), F.lit(0)) + F.when(text.rlike(f"[{ACCENTS}]"), 3).otherwise(0)
    en = sum((occurrences(text, m) for m in MARKS["en"]), F.lit(0))
    return F.when(en > it, "en").otherwise("it")


def bounded(x: Column, limit: int) -> Column:
    """White space collapsed; null if longer than ``limit`` or with table markup."""
    flat = F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " "))
    return F.when((F.length(flat) <= limit) & ~flat.contains("<table"), flat)


def head_tail(x: Column, limit: int) -> Column:
    """First and last half of a text longer than ``limit``."""
    half = limit // 2
    return F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(half)), F.lit("\n...\n"), F.right(x, F.lit(half)))).otherwise(x)


def amount_it(x: Column) -> Column:
    """``1.234,56`` as 1234.56; null if it isn't such an amount."""
    plain = F.replace(F.replace(F.regexp_replace(x, "[€ ]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(x.rlike(r"^€? ?-?[0-9]{1,3}(\.?[0-9]{3})*(,[0-9]{1,2})? ?€?$"), plain.try_cast("double"))


def date_it(x: Column) -> Column:
    """``d/m/y`` as an ISO string; two-digit years from 50 on are of the last century."""
    day, month, year = (F.regexp_extract(x, r"([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})", i) for i in (1, 2, 3))
    full = F.when(F.length(year) == 4, year).when(year >= "50", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    return F.when(day != "", F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


#: Words in titles that tell a family of documents; the first that a title holds counts.
FAMILIES = {
    "regolamento": "regulation",
    "regulations": "regulation",
    "assemblea": "assembly",
    "assembly": "assembly",
    "verbale": "minutes",
    "minutes": "minutes",
    "preventivo": "quote",
    "quote": "quote",
    "fattura": "invoice",
    "invoice": "invoice",
    "bolletta": "invoice",
    "statement": "statement",
    "estratto": "statement",
    "contract": "contract",
    "contratto": "contract",
    "privacy": "privacy",
    "catasto": "cadastre",
    "cadastral": "cadastre",
    "tax": "tax",
    "tarsu": "tax",
    "ici": "tax",
    "rai": "tax",
}


def family(title: Column) -> Column:
    """Family of documents that a title names, else null."""
    low = F.lower(title)
    out = F.lit(None).cast("string")
    for word, name in reversed(FAMILIES.items()):
        out = F.when(low.contains(word), name).otherwise(out)
    return out
