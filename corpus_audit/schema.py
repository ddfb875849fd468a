"""Record layouts shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

FINDING = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("axiom", T.IntegerType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("source", T.ArrayType(T.StringType())),
    T.StructField("severity", T.StringType()),
    T.StructField("finding_id", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("owasp", T.StringType()),
    T.StructField("sub_category", T.StringType()),
    T.StructField("convention_id", T.StringType()),
    T.StructField("exemplar", T.StringType()),
    T.StructField("enforced_as", T.StringType()),
    T.StructField("degraded", T.StringType()),
])

REQUIRED_FINDING_FIELDS = ("axiom", "rule_id", "path", "line_start", "line_end", "message", "tier", "severity")

# The axes a finding can belong to.
AXES = {
    1: "structural",
    2: "acceptance-criteria",
    3: "cleanliness",
    4: "non-functional",
    5: "security",
    6: "conformance",
}

# Severity levels, strongest last.
SEVERITY_RANK = {"info": 1, "warning": 2, "error": 3}

# The two published severity scales on one.
SEVERITY_SCALE = {
    "Critical": "error",
    "High": "error",
    "Medium": "warning",
    "Low": "info",
    "error": "error",
    "warning": "warning",
    "info": "info",
}

# The ten OWASP 2025 categories.
OWASP = {
    "A01": "Broken Access Control",
    "A02": "Security Misconfiguration",
    "A03": "Software Supply Chain Failures",
    "A04": "Cryptographic Failures",
    "A05": "Injection",
    "A06": "Insecure Design",
    "A07": "Identification and Auth Failures",
    "A08": "Software and Data Integrity Failures",
    "A09": "Security Logging and Alerting Failures",
    "A10": "Mishandling of Exceptional Conditions",
}
