"""Fixed configuration as small in-memory tables.

Everything here comes with the code, so its size is known; tables that grow with
the data are never built this way.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Chunking rules per document type
# (type, unit, token budget, breadcrumb prefix, module prefix, procedure prefix).
DOC_TYPE_RULES = [
    ("structured_manual", "section", 1500, True, False, False),
    ("module_manual", "section", 1500, False, True, False),
    ("operational_guide", "procedure", 800, False, False, True),
    ("changelog_as_manual", "functional_topic", 1000, False, False, False),
    ("changelog_pure", "single", 2000, False, False, False),
    ("faq_document", "qa_pair", 600, False, False, False),
    ("technical_spec", "section", 1200, False, False, False),
    ("training_material", "slide_group", 1000, False, False, False),
]
DEFAULT_RULE = ("section", 1500, False, False, False)
RULE_SCHEMA = ("doc_type string, chunk_unit string, max_tokens int, breadcrumb boolean, "
               "module_name boolean, procedure_title boolean")

# List prices in USD per 1,000 tokens or per unit.
# (version, provider, model, operation, metric, unit, per_1k, in_1k, out_1k, thoughts_1k)
PRICES = [
    ("2026-04-10", "voyage", None, "embed", "total_tokens", 0.0, 0.00006, 0.0, 0.0, 0.0),
    ("2026-04-10", "voyage", None, "rerank", "total_tokens", 0.0, 0.00005, 0.0, 0.0, 0.0),
    ("2026-04-10", "cohere", None, "rerank", "search_units", 0.002, 0.0, 0.0, 0.0, 0.0),
    ("2026-04-10", "google", None, "embed", "total_tokens", 0.0, 0.00002, 0.0, 0.0, 0.0),
    ("2026-04-10", "google", None, "generate_text", "io_tokens", 0.0, 0.0, 0.0001, 0.0004, 0.0004),
    ("2026-04-10", "google", None, "generate_multimodal", "io_tokens", 0.0, 0.0, 0.0001, 0.0004, 0.0004),
    ("2026-04-10", "google", "gemini-2.5-flash", "generate_text", "io_tokens", 0.0, 0.0, 0.0003, 0.0025, 0.0025),
    ("2026-04-10", "google", "gemini-2.5-flash", "generate_multimodal", "io_tokens", 0.0, 0.0, 0.0003, 0.0025, 0.0025),
    ("2026-04-10", "openai_compat", None, "generate_text", "io_tokens", 0.0, 0.0, 0.00015, 0.0006, 0.0006),
    ("2026-04-10", "openai_compat", None, "generate_multimodal", "io_tokens", 0.0, 0.0, 0.00015, 0.0006, 0.0006),
    ("2026-04-10", "openai_compat", "gpt-4", "generate_text", "io_tokens", 0.0, 0.0, 0.03, 0.06, 0.06),
    ("2026-04-10", "ollama", None, "generate_text", "io_tokens", 0.0, 0.0, 0.0, 0.0, 0.0),
]
PRICE_SCHEMA = ("version string, provider string, model string, operation string, metric string, "
                "unit double, per_1k double, in_1k double, out_1k double, thoughts_1k double")
CURRENCY = "USD"

# Least hit rate at 3 per document type, for image-derived pairs, and overall.
MIN_HR3 = [
    ("doc_type", "faq_document", 0.90),
    ("doc_type", "structured_manual", 0.85),
    ("doc_type", "operational_guide", 0.82),
    ("doc_type", "module_manual", 0.80),
    ("doc_type", "changelog_as_manual", 0.70),
    ("difficulty", "L3", 0.65),
]
MIN_HR3_OVERALL = 0.85

# Target shares of a generated benchmark, in per cent.
TARGET_SHARES = [
    ("difficulty", "L1", 40), ("difficulty", "L2", 40), ("difficulty", "L3", 20),
    ("doc_type", "structured_manual", 25), ("doc_type", "operational_guide", 20),
    ("doc_type", "module_manual", 20), ("doc_type", "changelog_as_manual", 15),
    ("doc_type", "others", 20),
]
MIN_VALIDATED = 300

# Glossary entries a new installation starts with (term, aliases, expansion).
GLOSSARY_SEED = [
    ("SSO", ["sso", "single sign on", "single sign-on", "sso login"], "single sign-on authentication SAML OIDC"),
    ("2FA", ["2fa", "two factor", "two-factor", "2 factor authentication", "mfa", "multi factor"],
     "two-factor authentication authenticator"),
    ("ACL", ["acl", "access control list", "permissions list", "file permissions"], "access control list permissions"),
    ("workspace", ["workspace", "work space", "team workspace"], "team workspace members"),
    ("shared drive", ["shared drive", "shared folder", "team drive"], "shared drive team folder"),
    ("API key", ["api key", "api token", "access token", "developer key"], "API key developer token"),
    ("webhook", ["webhook", "web hook", "callback url"], "webhook callback notification event"),
    ("retention policy", ["retention policy", "data retention", "retention rule"], "data retention policy auto delete"),
    ("audit log", ["audit log", "audit trail", "activity log"], "audit log activity trail compliance"),
]
GLOBAL_TENANT = "__global__"
GLOSSARY_SCHEMA = "id int, tenant_id string, term string, aliases array<string>, expansion string, enabled boolean"
TENANT_SCHEMA = ("tenant_id string, erp_version string, legacy_erp_version string, modules array<string>, "
                 "has_robot boolean, preferred_lang string")
DEMO_TENANT = ("demo", "5.0", None, [], True, "en")


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows that travel inside the plan, so that Spark knows how few they are and broadcasts
    them by its own threshold; a table above it is joined by shuffling."""
    schema = T.StructType.fromDDL(ddl)
    data = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(data, schema)


def doc_type_rules(spark: SparkSession) -> DataFrame:
    return small_table(spark, DOC_TYPE_RULES, RULE_SCHEMA)


def prices(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return small_table(spark, PRICES if rows is None else rows, PRICE_SCHEMA)


def hr3_floors(spark: SparkSession) -> DataFrame:
    return small_table(spark, MIN_HR3, "dim string, grp string, min_hr3 double")


def target_shares(spark: SparkSession) -> DataFrame:
    return small_table(spark, TARGET_SHARES, "kind string, key string, share_pct int")


def tenants(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return small_table(spark, [DEMO_TENANT] if rows is None else rows, TENANT_SCHEMA)


def glossary(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Glossary rows; blank terms and aliases are dropped, as on first start."""
    if rows is None:
        rows = [(i, GLOBAL_TENANT, t, a, x, True) for i, (t, a, x) in enumerate(GLOSSARY_SEED, 1)]
    clean = [(i, ten, t.strip(), [a.strip() for a in al if a.strip()], x.strip(), on)
             for i, ten, t, al, x, on in rows if t.strip()]
    return small_table(spark, clean, GLOSSARY_SCHEMA)
