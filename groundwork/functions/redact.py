"""Masking of credentials in text, and of columns by their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "***REDACTED***"
CONTENT_MASK = "***REDACTED_CONTENT***"
LIMIT = 200
# Parts of names that make a column sensitive, and names that hold content.
SENSITIVE = ("api_key", "apikey", "api-key", "authorization", "token", "cookie", "secret", "password", "passwd", "credential")
CONTENT = ("raw_text", "transcript", "ocr_text", "text", "content", "prompt", "response", "llm_request", "llm_response", "vault_content", "body")
# Credentials inside text; the parts in groups stay.
PATTERNS = (
    (r"sk-[A-Za-z0-9_\-]{8,}", MASK),
    (r"(?i)(bearer)(\s+)([A-Za-z0-9._\-]{8,})", "$1$2" + MASK),
    (r"""(?i)((?:api[-_]?key|access[-_]?token|refresh[-_]?token|token|secret|password|passwd|cookie|authorization|signature)\s*[=:]\s*)(?!(?:bearer|basic|token)\b)([^\s,;'"]{4,})""", "$1" + MASK),
)


def scrub(text: Column) -> Column:
    for pattern, mask in PATTERNS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def redact_credentials(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns scrubbed, and `redaction_hits`: how many masks were put in, over all of them."""
    masks = lambda c: F.size(F.split(F.coalesce(c, F.lit("")), MASK.replace("*", r"\*"))) - 1
    hits = sum((masks(scrub(F.col(c))) - masks(F.col(c)) for c in cols), F.lit(0))
    return df.select("*", hits.cast("long").alias("redaction_hits")).withColumns({c: scrub(F.col(c)) for c in cols})


def _kind(name: str) -> str:
    low = name.strip().lower()
    if any(s in low for s in SENSITIVE):
        return "sensitive"
    return "content" if low in CONTENT or any(low.endswith("_" + c) for c in CONTENT) else "plain"


def _shortened(text: Column) -> Column:
    return F.when(F.length(text) > LIMIT, F.concat(F.substring(text, 1, LIMIT), F.lit("...<truncated "), (F.length(text) - LIMIT).cast("string"), F.lit(" chars>"))).otherwise(text)


def _masked(value: Column, kind: T.DataType, name: str, show_content: bool) -> Column:
    role = _kind(name)
    if role == "sensitive":
        return F.lit(MASK)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_masked(value[f.name], f.dataType, f.name, show_content).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, T.StringType):
            low = lambda k: F.lower(F.trim(k))
            sensitive = lambda k: low(k).rlike("|".join(SENSITIVE))
            content = lambda k: low(k).rlike("^(.*_)?(" + "|".join(CONTENT) + ")$")
            hidden = F.lit(CONTENT_MASK) if not show_content else None
            return F.transform_values(value, lambda k, v: F.when(sensitive(k), MASK).when(content(k), hidden if hidden is not None else _shortened(scrub(v))).otherwise(scrub(v)))
        return value
    if not isinstance(kind, T.StringType):
        return F.lit(CONTENT_MASK) if role == "content" and not show_content else value
    if role == "content":
        return _shortened(scrub(value)) if show_content else F.lit(CONTENT_MASK)
    return scrub(value)


def mask_columns(df: DataFrame, show_content: bool = False) -> DataFrame:
    """Columns with a sensitive name are masked, content is hidden or scrubbed and cut, other text is scrubbed; structs and maps inside too."""
    return df.select(*(_masked(F.col(f"`{f.name}`"), f.dataType, f.name, show_content).alias(f.name) for f in df.schema.fields))
