"""Gap severity and type compatibility, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SQL types that a Java type may be stored in.
SQL_TYPES = {
    "String": ("VARCHAR", "CHAR", "TEXT", "NVARCHAR", "CLOB"),
    "Long": ("BIGINT", "NUMBER", "NUMERIC", "INT8"),
    "Integer": ("INT", "INTEGER", "NUMBER", "INT4"),
    "Double": ("DOUBLE", "DECIMAL", "FLOAT", "NUMBER", "NUMERIC"),
    "BigDecimal": ("DECIMAL", "NUMERIC", "NUMBER"),
    "Boolean": ("BOOLEAN", "BIT", "TINYINT", "CHAR(1)"),
    "LocalDate": ("DATE",),
    "LocalDateTime": ("DATETIME", "TIMESTAMP"),
    "Date": ("DATE", "DATETIME", "TIMESTAMP"),
    "byte[]": ("BLOB", "BYTEA", "BINARY", "VARBINARY"),
}


def severity_rank(severity: Column) -> Column:
    """0 for HIGH and critical, 1 for MEDIUM and warning, 2 for the rest."""
    return F.when(severity.isin("HIGH", "critical"), 0).when(severity.isin("MEDIUM", "warning"), 1).otherwise(2)


def type_compatible(java: Column, sql: Column) -> Column:
    """Whether a column of SQL type ``sql`` can hold Java type ``java``; lengths, ? and generics do not count."""
    j = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(java, r"\?$", ""), "<.*>$", ""), r"\s+", ""))
    s = F.upper(F.trim(F.regexp_replace(sql, r"\?$", "")))
    s = F.when(s == "CHAR(1)", s).otherwise(F.regexp_replace(s, r"\(.*\)$", ""))
    out = F.upper(j) == s
    for name, types in SQL_TYPES.items():
        out = out | ((j == name.lower()) & s.isin(*types))
    return out


def gap_severity(kind: Column, primary: Column, required: Column, external: Column, java: Column | None = None, sql: Column | None = None) -> Column:
    """HIGH, MEDIUM or LOW by gap type (MID, MC, TM, PM, SM) and context; null flags are unknown."""
    pk, req, ext = F.coalesce(primary, F.lit(False)), F.coalesce(required, F.lit(False)), F.coalesce(external, F.lit(False))
    fits = F.coalesce(type_compatible(java, sql), F.lit(False)) if java is not None and sql is not None else F.lit(False)
    return (
        F.when(kind == "MID", F.when(pk | ext, "HIGH").when(external.isNotNull(), "LOW").otherwise("MEDIUM"))
        .when(kind == "MC", F.when(pk | req, "HIGH").otherwise("MEDIUM"))
        .when(kind == "TM", F.when(pk, "HIGH").when(fits, "MEDIUM").otherwise("HIGH"))
        .when(kind == "PM", F.when(req, "HIGH").otherwise("MEDIUM"))
        .when(kind == "SM", F.when(pk, "HIGH").when(req, "MEDIUM").otherwise("LOW"))
        .otherwise("MEDIUM")
    )
