"""What tables there are, concept tags, settings and the error contract."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: addresses of public vocabularies with their labels
_SCHOLARLY, _SEARCH, _RETRIEVAL, _ARTICLE_ID, _ACCESSION = ("https://schema.org/ScholarlyArticle", "Scholarly article"), ("https://schema.org/SearchAction", "Search action"), ("https://edamontology.org/operation_2422", "Data retrieval"), ("https://edamontology.org/data_1187", "PubMed ID"), ("https://edamontology.org/data_2091", "Accession")
_DATABASE, _MAPPING, _FORMAT, _WORK, _TERMS = ("https://edamontology.org/operation_2421", "Database search"), ("https://edamontology.org/operation_3282", "ID mapping"), ("https://edamontology.org/operation_0335", "Data formatting"), ("https://schema.org/CreativeWork", "Creative work"), ("https://edamontology.org/topic_0089", "Ontology and terminology")
CONCEPTS = {
    "search": (_SEARCH, _DATABASE, _ARTICLE_ID),
    "corpus_search": (_SEARCH, _DATABASE, _ARTICLE_ID),
    "fetch": (_SCHOLARLY, _RETRIEVAL, _ARTICLE_ID),
    "corpus_fetch": (_SCHOLARLY, _RETRIEVAL, _ACCESSION),
    "fulltext": (_SCHOLARLY, _RETRIEVAL),
    "related": (_SCHOLARLY, _RETRIEVAL),
    "match": (_SCHOLARLY, _RETRIEVAL, _ARTICLE_ID),
    "convert": (_MAPPING, _ACCESSION),
    "cite": (_WORK, _FORMAT),
    "vocabulary": (("https://schema.org/DefinedTerm", "Defined term"), ("https://schema.org/DefinedTermSet", "Defined term set"), _TERMS),
    "spell": (_SEARCH,),
}
# fixed values: the reasons a service call may fail for, their codes, whether to try again, and what to do
ERRORS = {
    "queue_full": ("RateLimited", True, "Wait until requests have finished."),
    "records_unreachable": ("ServiceUnavailable", True, "Try again later."),
    "records_deadline_exceeded": ("Timeout", True, "Ask for less at once."),
    "records_invalid_response": ("SerializationError", True, "Try again; the reply could not be read."),
    "records_not_found": ("NotFound", False, "Check the id or search for it."),
    "access_unreachable": ("ServiceUnavailable", True, "Try again later, or without this source."),
    "graph_unreachable": ("ServiceUnavailable", True, "Try again later, or with another provider."),
    "graph_invalid_response": ("SerializationError", True, "Try again; the reply could not be read."),
    "corpus_unreachable": ("ServiceUnavailable", True, "Try again later, or with the first corpus."),
    "corpus_invalid_response": ("SerializationError", True, "Try again; the reply could not be read."),
    "corpus_invalid_input": ("ValidationError", False, "Check the query's form."),
}


def setting(default: object, low: float | None = None, high: float | None = None):
    return field(default=default, metadata={"low": low, "high": high})


@dataclass(frozen=True)
class Settings:
    """Typed settings with their ranges; `read` takes them from a mapping of names to texts, such as a session's configuration."""

    api_key: str | None = setting(None)
    tool: str = setting("litgrid")
    admin_email: str | None = setting(None)
    request_delay_ms: int = setting(334, 50, 5000)
    max_concurrent: int = setting(8, 1, 16)
    max_retries: int = setting(6, 0, 10)
    timeout_ms: int = setting(30_000, 1000, 120_000)
    total_deadline_ms: int = setting(60_000, 5000, 600_000)
    access_email: str | None = setting(None)
    access_timeout_ms: int = setting(20_000, 1000, 120_000)
    corpus_enabled: bool = setting(True)
    corpus_email: str | None = setting(None)
    corpus_request_delay_ms: int = setting(200, 50, 5000)
    corpus_max_retries: int = setting(3, 0, 10)
    corpus_timeout_ms: int = setting(20_000, 1000, 120_000)

    @classmethod
    def read(cls, given: Mapping[str, str], prefix: str = "litgrid.") -> Settings:
        """A text that is no number or no truth value, is out of range, or is no address where one is asked for, is an error; an empty one is as none. With a key and no delay given the delay is 100 ms."""
        values: dict[str, object] = {}
        for f in fields(cls):
            raw = given.get(prefix + f.name)
            if raw is None or not raw.strip():
                continue
            if f.type.startswith("int"):
                value: object = int(raw)
                if not f.metadata["low"] <= value <= f.metadata["high"]:
                    raise ValueError(f"{f.name}: {f.metadata['low']} to {f.metadata['high']}")
            elif f.type == "bool":
                if raw.strip().lower() not in ("true", "false", "1", "0", "yes", "no", "on", "off"):
                    raise ValueError(f"{f.name}: true or false")
                value = raw.strip().lower() in ("true", "1", "yes", "on")
            else:
                value = raw.strip()
                if f.name.endswith("email") and ("@" not in value[1:-1] or " " in value):
                    raise ValueError(f"{f.name}: an e-mail address")
            values[f.name] = value
        if values.get("api_key") and "request_delay_ms" not in values:
            values["request_delay_ms"] = 100
        return cls(**values)


def table_info(rows: DataFrame, name: str) -> DataFrame:
    """name, description, fields (names and types), n_columns, n_rows, last_key: the largest of the first column, which the reader prunes to."""
    key = rows.columns[0]
    about = F.lit(f"{len(rows.columns)} columns by {key}")
    return rows.agg(F.count("*").alias("n_rows"), F.max(key).cast("long").alias("last_key")).select(F.lit(name).alias("name"), about.alias("description"), F.lit(",".join(rows.columns)).alias("fields"), F.lit(len(rows.columns)).alias("n_columns"), "n_rows", "last_key")


def error_contract(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in ERRORS.items()], "reason string, code string, retryable boolean, hint string")
