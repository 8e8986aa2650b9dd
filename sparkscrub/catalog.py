"""The 17 entity types: descriptions, default selection and rank."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Entity type, description, selected by default; in the order in
# which the types are offered to the user.
ENTITIES = (
    ("PERSON", "A person's full name (first, middle, last etc)", True),
    ("EMAIL_ADDRESS", "An email address (RFC-822 style)", True),
    ("PHONE_NUMBER", "A telephone number", True),
    ("LOCATION", "Geographic locations (cities/provinces/countries/regions)", True),
    ("CREDIT_CARD", "A credit card number (12-19 digits)", True),
    ("US_SSN", "US Social Security Number (9 digits)", True),
    ("DATE_TIME", "Absolute or relative dates/times", False),
    ("URL", "A URL pointing to a resource on the Internet", False),
    ("IP_ADDRESS", "An IP address (IPv4 or IPv6)", False),
    ("CRYPTO", "Cryptocurrency wallet number (Bitcoin addresses)", False),
    ("IBAN_CODE", "International Bank Account Number (IBAN)", False),
    ("NRP", "Nationality, religious or political group", False),
    ("MEDICAL_LICENSE", "A medical licence number", False),
    ("US_BANK_NUMBER", "A US bank account number (8-17 digits)", False),
    ("US_DRIVER_LICENSE", "A US driver's licence number", False),
    ("US_ITIN", "US Individual Taxpayer ID (9 digits, starts with 9)", False),
    ("US_PASSPORT", "US passport number (9 digits)", False),
)

# One value can look like several types (nine digits may be a passport or a bank
# account). The type that comes first here names it: types with a checksum or a
# fixed shape first, bare digits last.
RANKED_TYPES = (
    "IBAN_CODE",
    "CREDIT_CARD",
    "CRYPTO",
    "MEDICAL_LICENSE",
    "EMAIL_ADDRESS",
    "URL",
    "IP_ADDRESS",
    "US_ITIN",
    "US_SSN",
    "PHONE_NUMBER",
    "DATE_TIME",
    "PERSON",
    "LOCATION",
    "NRP",
    "US_DRIVER_LICENSE",
    "US_PASSPORT",
    "US_BANK_NUMBER",
)
RANK = {entity_type: i for i, entity_type in enumerate(RANKED_TYPES, start=1)}

DICTIONARY_TYPES = ("PERSON", "LOCATION", "NRP")
DEFAULT_TYPES = tuple(t for t, _, selected in ENTITIES if selected)

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("selected", T.BooleanType(), False),
        T.StructField("entity_type", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("rank", T.IntegerType(), False),
    ]
)


def entity_catalog(spark: SparkSession, selected: Iterable[str] | None = None) -> DataFrame:
    """The catalogue as a table, ``selected`` marking ``selected`` or the default types."""
    chosen = set(DEFAULT_TYPES if selected is None else select_entities(selected))
    rows = [(t in chosen, t, description, RANK[t]) for t, description, _ in ENTITIES]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def select_entities(entities: Iterable[str] | None = None) -> tuple[str, ...]:
    """The chosen entity types in rank order; an empty or missing choice means all of them."""
    if isinstance(entities, str):
        raise TypeError("entities must be a list of entity types, not one string")
    chosen = set(entities or ())
    unknown = chosen - RANK.keys()
    if unknown:
        raise ValueError(f"unknown entity types: {sorted(unknown)}")
    return tuple(t for t in RANKED_TYPES if not chosen or t in chosen)


def placeholder(entity_type: str) -> str:
    """What stands in the masked text for a value of this type."""
    return f"<{entity_type}>"
